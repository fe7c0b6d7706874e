"""Ordered computations: ranks, tails, adjacent comparisons, spaced sub-samples, schedules and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_weights(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], alpha: float) -> DataFrame:
    """rank / (n - 1) in the given order, and the weight 1 + alpha * rank score."""
    w = Window.partitionBy(*by)
    score = (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return rows.withColumn("rank_score", score).withColumn("sample_weight", 1.0 + alpha * F.col("rank_score"))


def top_fraction(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], fraction: float) -> DataFrame:
    """The last max(1, ceil(fraction * n)) rows of each group in the given order."""
    w = Window.partitionBy(*by)
    back = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(*order)) + 1
    keep = F.greatest(F.lit(1).cast("long"), F.ceil(fraction * F.count(F.lit(1)).over(w)))
    return rows.withColumn("_b", back).withColumn("_k", keep).filter("_b <= _k").drop("_b", "_k")


def pool_size(total: int, percent: float | None = None, n: int | None = None) -> int:
    """Rows of a hard pool: ``n`` of them, or a share (above 1: in percent)."""
    import math

    if total <= 0:
        return 0
    if n is not None:
        return min(n, total)
    if percent is None:
        raise ValueError("a share or a number is needed")
    share = percent / 100 if percent > 1 else percent
    return max(1, math.ceil(total * share))


def linspace(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """At most ``size`` rows of each group, evenly spaced over its order, both ends included."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    slot = F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(size)).cast("int") - 1))
    want = r.select(*by, "_n").distinct().withColumn("_s", slot)
    want = want.select(*by, F.floor(F.col("_s") * (F.col("_n") - 1) / F.greatest(F.least(F.col("_n"), F.lit(size)) - 1, F.lit(1))).alias("_i")).distinct()
    return r.join(want, [*by, "_i"]).drop("_i", "_n")


def lr_scale(step: Column, total: int, warmup: int, decay: int, kind: str, least: float) -> Column:
    """Learning-rate scale: linear warm-up, then constant, linear or cosine decay down to ``least``."""
    from math import pi

    rise = (step + 1) / float(max(warmup, 1))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(decay, 1))))
    fall = {"constant": F.lit(1.0), "linear": 1.0 - (1.0 - least) * share, "cosine": least + (1.0 - least) * 0.5 * (1.0 + F.cos(pi * share))}[kind]
    return F.when(step < warmup, rise).otherwise(fall)


def eval_due(step: Column, interval: int) -> Column:
    """Whether a step ends an evaluation interval."""
    return (step > 0) & (step % interval == 0)


def optimizer_steps(batches: Column, accumulation: int, epoch_batches: int) -> Column:
    """Optimizer steps after some batches of an epoch; the epoch's last, short group counts."""
    return F.floor(batches / accumulation) + F.when((batches >= epoch_batches) & (batches % accumulation != 0), 1).otherwise(0)


def nucleus(rows: DataFrame, by: Sequence[str], logit: str, tie: str, k: int, p: float) -> DataFrame:
    """Bins left by a top-k and then a nucleus filter, with renormalised probabilities."""
    w = Window.partitionBy(*by).orderBy(F.desc(logit), tie)
    top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    whole = Window.partitionBy(*by)
    e = F.exp(F.col(logit) - F.max(logit).over(whole))
    top = top.withColumn("_e", e).withColumn("_p", F.col("_e") / F.sum("_e").over(whole))
    before = F.coalesce(F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = top.withColumn("_c", before).filter(F.col("_c") < p)
    return kept.withColumn("prob", F.col("_e") / F.sum("_e").over(whole)).drop("_r", "_e", "_p", "_c")


def pareto(rows: DataFrame, by: Sequence[str], cost: str, gain: str) -> DataFrame:
    """Rows that no row of their group beats: none costs less or equal for more, or less for as much.

    A running maximum over the costs does it in one sort for each group, without a self-join.
    """
    best = rows.groupBy(*by, cost).agg(F.max(gain).alias("_best"))
    w = Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_cheaper", F.max("_best").over(w))
    front = best.filter(F.col("_cheaper").isNull() | (F.col("_best") > F.col("_cheaper"))).select(*by, cost, F.col("_best").alias(gain))
    return rows.join(front, [*by, cost, gain], "left_semi")


def interval_overlap(pieces: DataFrame, shards: DataFrame, width: int) -> DataFrame:
    """Overlaps of [ps, pe) with [ss, se): an equi-join on the buckets of ``width`` that both touch, then the exact test.

    Each overlap is reported once, from the bucket that holds its start.
    """
    span = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(z) - 1) / width)))
    p = pieces.filter("pe > ps").withColumn("_b", span("ps", "pe"))
    s = shards.filter("se > ss").withColumn("_b", span("ss", "se"))
    out = p.join(s, "_b").filter("ps < se and ss < pe").withColumn("lo", F.greatest("ps", "ss")).withColumn("hi", F.least("pe", "se"))
    return out.filter(F.floor(F.col("lo") / width) == F.col("_b")).drop("_b")
