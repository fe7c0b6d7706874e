"""Queries over the driver's tables, one for each operator of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Dated entries of the lists that op1 applies.
LIST_ENTRIES = [
    ("spam", "domain", "tionsh.example.net", "2024-02-01", "add"),
    ("spam", "domain", "tionsh.example.net", "2024-05-01", "remove"),
    ("spam", "domain", "tionsh.example.net", "2024-09-15", "add"),
    ("spam", "domain", "Example.ORG", "2024-03-10", "add"),
    ("spam", "domain", "example.org", "2024-03-20", "remove"),
    ("adult", "domain", "blog.tionble.example.com", "2023-06-01", "add"),
    ("adult", "domain", "blog.ththth.example.org", "2024-07-01", "add"),
    ("adult", "domain", "blog.ththth.example.org", "2024-07-01", "remove"),
    ("legal", "path", "m.tiontion.example.com/fr", "2024-01-15", "add"),
    ("legal", "path", "m.tiontion.example.com/fr", "2024-11-15", "remove"),
    ("legal", "path", "WWW.thering.example.org/de/", "2024-04-01", "add"),
    ("legal", "url", "https://TherHa.example.net:443/en/35332/", "2024-01-01", "add"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures carry no time, so a page is fetched on the day 7 * page_id modulo 366 of 2024."""
    from stridelake.llm.url_filter import filter_urls

    values = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in LIST_ENTRIES)
    entries = spark.sql(f"SELECT * FROM VALUES {values} AS t(list, kind, key, day, action)")
    day = F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id * 7, 366) as int))")
    out = filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), entries, fetched=day)
    return out.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.decontaminate import contaminated

    out = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("fp")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stridelake.llm.token_orc import tokens_to_orc

    return tokens_to_orc(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def mixing_levels() -> dict:
    """Domain (a source's number modulo 4), language, source."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return {"domain": F.concat(F.lit("domain"), F.when(number == "", F.lit("")).otherwise((number.cast("int") % 4).cast("string"))), "lang": F.col("lang"), "source": F.col("source")}


#: The weights of op5 by (depth, name).
MIX_WEIGHTS = {(0, "domain0"): 1.0, (0, "domain1"): 3.0, (0, "domain2"): 2.0, (0, "domain3"): 2.0, (1, "en"): 4.0, (1, "de"): 2.0, (1, "fr"): 2.0, (1, "es"): 2.0}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), mixing_levels(), MIX_WEIGHTS, budget=0.9, epochs=2, seed=7).drop("fp")


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation are a tree without branches: each replies to the row before it.

    Rows are numbered by turn (null first), role and text, so rows that repeat or tie all take part.
    """
    from pyspark.sql import Window

    from stridelake.llm.chat_tree import format_chats, read_loss, read_turns

    said = "\\### Assistant: </turn> ok"
    pair = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("x")
    extra = spark.range(1).select(pair).select(F.lit(-7).cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), "x.role", F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", number)
    score = F.when(F.col("role") == "assistant", F.char_length("text")).otherwise(0)
    tree = rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", score.alias("score"))
    out = format_chats(tree)
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = read_loss(F.col("formatted"), F.col("loss_mask"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.radix_dedup import radix_dedup

    return radix_dedup(_table(spark, sf_dir, "documents"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.chosen_path import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, similarity_pct=80).drop("fp")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.pii_crf import detect

    return detect(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm.quality_eb import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("fp")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_decontaminate, op4_token_orc, op5_mixing, op6_chat_trees, op7_exact_dedup, op8_chosen_path, op9_pii, op10_quality)
}
