"""From raw documents to token files: five stages, each over all that the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns the columns of ``docs``;
the last returns the index of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridelake.llm._store import cut, gathered
from stridelake.llm.chosen_path import near_duplicates
from stridelake.llm.decontaminate import contaminated
from stridelake.llm.mixing import mix
from stridelake.llm.quality_eb import score
from stridelake.llm.queries import MIX_WEIGHTS, mixing_levels
from stridelake.llm.rows import select_rows
from stridelake.llm.token_orc import tokens_to_orc


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gathered(select_rows(docs, scored.filter("not kept"), "left_anti"), docs.count())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the smallest id stays."""
    return gathered(select_rows(docs, near_duplicates(docs, k=5, similarity_pct=80).filter("not kept"), "left_anti"), docs.count())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return gathered(select_rows(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "left_anti"), docs.count())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt to domains, languages and sources by weight."""
    taken = mix(docs, mixing_levels(), MIX_WEIGHTS, budget=0.9, epochs=1, seed=7)
    return gathered(select_rows(docs, taken.select("doc_id", "fp", "epoch").distinct(), "inner"), docs.count())


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, read back as (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    return tokens_to_orc(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token-ID output", token_output),
]

#: SQL can't express the stages' classifier, trees and files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
