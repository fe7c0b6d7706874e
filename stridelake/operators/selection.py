"""Selecting rows: keys, ranges, n-th records, caps and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted; only keys move beside the rows."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def except_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), list(on), "left_anti")


def resolve_names(mode: str, names: Sequence[str], available: Sequence[str]) -> list[str]:
    """Names chosen by 'single', 'all' or 'except'; unknown and repeated names are errors."""
    if len(set(names)) != len(names):
        raise ValueError("repeated names")
    if unknown := set(names) - set(available):
        raise ValueError(f"unknown names: {sorted(unknown)}")
    if mode == "all":
        return list(available)
    if mode == "except":
        left = [a for a in available if a not in set(names)]
        if not left:
            raise ValueError("nothing is left")
        return left
    if mode == "single":
        if len(names) != 1:
            raise ValueError("exactly one name is asked for")
        return list(names)
    raise ValueError(f"unknown mode: {mode}")


def normalize_ranges(ranges: Sequence[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Half-open ranges in order; empty, overlapping and outlying ranges are errors."""
    out = sorted((int(a), int(z)) for a, z in ranges)
    for i, (a, z) in enumerate(out):
        if z <= a:
            raise ValueError(f"empty range [{a}, {z})")
        if a < low or z > high:
            raise ValueError(f"range [{a}, {z}) lies outside [{low}, {high})")
        if i and a < out[i - 1][1]:
            raise ValueError("overlapping ranges")
    return out


def in_ranges(rows: DataFrame, key: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows in one of a few half-open ranges, with the range's start; a predicate that scans can push down."""
    start = F.coalesce(*(F.when((F.col(key) >= a) & (F.col(key) < z), F.lit(a)) for a, z in ranges))
    any_of = F.lit(False)
    for a, z in ranges:
        any_of = any_of | ((F.col(key) >= a) & (F.col(key) < z))
    return rows.filter(any_of).withColumn("range_start", start)


def nth(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n-th row of each key, counted from 1 in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == n).drop("_n")


def cap(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key; the optimiser turns this into a limit on each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def compare_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: is the left set part of the right one, and are they equal?"""
    keys = left.columns
    both = left.distinct().withColumn("l", F.lit(1)).join(right.distinct().withColumn("r", F.lit(1)), keys, "full_outer")
    lost, extra = F.coalesce(F.count_if(F.col("r").isNull()), F.lit(0)), F.coalesce(F.count_if(F.col("l").isNull()), F.lit(0))
    return both.agg((lost == 0).alias("is_subset"), ((lost == 0) & (extra == 0)).alias("is_equal"))


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order in which they first came."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("kept"))
