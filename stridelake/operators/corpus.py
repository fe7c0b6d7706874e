"""Corpus bookkeeping: index and manifest scans, repair, validation, content hashes, guarded appends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A shard is ranked in ranges of about so many rows, in so many ranges at most.
RANGE_ROWS = 10_000
RANGES = 256

#: Schema of one line of a corpus index.
INDEX_SCHEMA = "episode_index long, episode_group string, map_seed long, trajectory_index long, map_hash string, map_rows int, map_cols int, step_count long"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index in JSON lines; a broken line fails the scan, blank lines are passed over."""
    return spark.read.schema(INDEX_SCHEMA).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str, kind: str, version: int, require_complete: bool = True) -> dict[str, Any]:
    """A one-row manifest, checked against its contract."""
    rows = spark.read.option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a manifest has exactly one record")
    m = rows[0].asDict(recursive=True)
    if m.get("kind") != kind or m.get("schema_version") != version:
        raise ValueError(f"not a manifest of kind {kind}, version {version}")
    if require_complete and not m.get("complete"):
        raise ValueError("the corpus is not complete")
    return m


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates: one row for each text file, named by its stem."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("template"), F.col("value").alias("text"))
    return raw.filter("template <> ''").orderBy("template")


def numeric_suffix(name: Column) -> Column:
    """The number behind the last underscore, so that episode_10 follows episode_9."""
    return F.regexp_extract(name, r"_([0-9]{1,18})$", 1).try_cast("long")


def repair_findings(data: DataFrame, index: DataFrame, key: str, extra: str, missing: str) -> DataFrame:
    """Keys of the data without index rows, and of index rows without data."""
    a, b = data.select(key), index.select(key)
    return a.join(b.distinct(), key, "left_anti").withColumn("finding", F.lit(extra)).unionByName(b.join(a.distinct(), key, "left_anti").withColumn("finding", F.lit(missing)))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def content_hash(rows: DataFrame, group: str, key: str, line: Column, bucket: int = 1000) -> DataFrame:
    """A hash of each group's lines in key order.

    Lines are hashed by buckets of neighbouring keys and the buckets' hashes are hashed
    again, so no task holds a whole group.
    """
    part = F.floor(F.col(key) / bucket)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["line"]), "\n")
    small = rows.groupBy(group, part.alias("_b")).agg(F.sha2(ordered(F.struct(F.col(key).alias("k"), line.alias("line"))), 256).alias("h"))
    return small.groupBy(group).agg(F.sha2(ordered(F.struct("_b", F.col("h").alias("line"))), 256).alias("content_hash"))


def _ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with the number of their range of ``order`` in ``_range``; a sample places the bounds, which are fixed values from there on."""
    n = rows.count()
    parts, key = min(RANGES, n // RANGE_ROWS + 1), F.struct(*order)
    if parts == 1:
        return rows.withColumn("_range", F.lit(0))
    sample = rows.select(key.alias("k"), F.pmod(F.xxhash64(*order), F.lit(max(1, n // (parts * 64)))).alias("h")).filter("h = 0").select("k").distinct().sort("k")
    got = [r.k for r in sample.collect()]
    bounds = [got[len(got) * i // parts] for i in range(1, parts)] if got else []
    fixed = rows.sparkSession.createDataFrame([(list(dict.fromkeys(bounds)),)], T.StructType([T.StructField("_bounds", T.ArrayType(sample.schema["k"].dataType))]))
    jumps = F.array(*(F.lit(1 << i) for i in reversed(range(RANGES.bit_length()))))
    place = F.aggregate(jumps, F.lit(0), lambda at, by: F.when(F.get("_bounds", at + by - 1) <= key, at + by).otherwise(at))
    return rows.crossJoin(F.broadcast(fixed)).withColumn("_range", place).drop("_bounds")


def append_rows(existing: DataFrame, new: DataFrame, keys: Sequence[str], index_col: str, order: Sequence[str]) -> DataFrame:
    """New rows with indexes that go on after the existing ones; keys that exist already are an error.

    The shard is cut in ranges of ``order``; their rows are counted first and then ranked by range, so no task holds
    the shard.  Rows equal in ``order`` share a range.  The shard is read several times and has to stay the same.
    """
    clash = new.join(existing.select(*keys), list(keys), "left_semi").limit(1).count() + duplicate_keys(new, keys).limit(1).count()
    if clash:
        raise ValueError("keys exist already or repeat")
    start = existing.agg(F.max(index_col)).first()[0]
    ranged = _ranges(new, order)
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before = accumulate((counts.get(i, 0) for i in range(max(counts, default=0))), initial=-1 if start is None else int(start))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    return ranged.withColumn(index_col, rank + F.get(F.array(*(F.lit(x).cast("long") for x in before)), F.col("_range"))).drop("_range")


def validate_corpus(index: DataFrame, data: DataFrame, per_seed: int) -> DataFrame:
    """Findings of a corpus: (map_seed, trajectory_index, finding)."""
    keys = ["map_seed", "trajectory_index"]
    both = index.select(*keys, F.col("step_count").alias("si")).join(data.select(*keys, F.col("step_count").alias("sd")), keys, "full_outer")
    checks = F.array(
        F.when(F.col("sd").isNull(), F.lit("no data")),
        F.when(F.col("si").isNull(), F.lit("not indexed")),
        F.when(F.col("si") != F.col("sd"), F.lit("step counts differ")),
        F.when((F.col("trajectory_index") < 0) | (F.col("trajectory_index") >= per_seed), F.lit("beyond capacity")),
    )
    one = both.select(*keys, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("finding"))
    return one.unionByName(duplicate_keys(index, keys).select(*keys, F.lit("repeated key").alias("finding")))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def signature(payload: Any, length: int = 16) -> str:
    """Name of a cache folder: the head of the hash of what determines its contents."""
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()[:length]


def publish(df: DataFrame, path: str, merge: Sequence[DataFrame] = ()) -> None:
    """Merge shards and write them once; an existing folder is an error, and Spark's committer makes the result appear whole."""
    for m in merge:
        df = df.unionByName(m)
    df.write.mode("errorifexists").parquet(path)
