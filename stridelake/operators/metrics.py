"""Evaluation metrics: rollout statistics, macro and micro rates, scores, summaries, moments, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def std_or_zero(c: Column) -> Column:
    """Population standard deviation; no rows give 0."""
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def seed_std(c: Column) -> Column:
    """Sample standard deviation; a single value gives 0."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def collapse(c: Column) -> Column:
    """Null for no value, the value if there is one only, else 'mixed'."""
    return F.when(F.count(c) == 0, F.lit(None)).when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit("mixed"))


def rate(c: Column) -> Column:
    return F.avg(c.cast("int").cast("double"))


def ratio_of_sums(num: Column, den: Column, scale: float = 1.0, digits: int = 2) -> Column:
    """scale * sum / sum, 0 for an empty denominator, rounded half to even."""
    return F.bround(F.coalesce(F.try_divide(F.sum(num) * scale, F.sum(den)), F.lit(0.0)), digits)


def rollout_metrics(episodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Success, first success, return and length of evaluation episodes by group; null where nothing succeeded.

    ``episodes``: success, first_success (null if none), ret, length, start, goal.
    """
    return episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("success").alias("successes"),
        rate(F.col("success")).alias("success_rate"),
        F.avg("first_success").alias("first_success_mean"),
        F.stddev_pop("first_success").alias("first_success_std"),
        F.avg("ret").alias("return_mean"),
        F.stddev_pop("ret").alias("return_std"),
        F.avg("length").alias("length_mean"),
    )


def with_total(frame: DataFrame, key: str, aggregate) -> DataFrame:
    """An aggregate by key together with the same aggregate over all rows, whose key is 'ALL'; one rollup, one shuffle."""
    out = aggregate(frame.withColumn(key, F.col(key).cast("string")).rollup(key))
    return out.withColumn(key, F.coalesce(key, F.lit("ALL")))


def macro_micro(results: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Mean of the units' rates (macro) and rate over all episodes (micro)."""
    each = results.groupBy(*by, unit).agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("k"))
    return each.groupBy(*by).agg(F.avg(F.col("k") / F.col("n")).alias("macro"), (F.sum("k") / F.sum("n")).alias("micro"), F.sum("n").alias("episodes"))


def seed_summary(values: DataFrame, by: Sequence[str], value: str, seed: str = "seed") -> DataFrame:
    """Mean, sample deviation and the values in the order of seeds (a handful)."""
    v = F.array_sort(F.collect_list(F.struct(seed, value)))
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), seed_std(F.col(value)).alias("std"), F.transform(v, lambda s: s[value]).alias("values"))


def normalized_score(mean: Column, low: Column, high: Column) -> Column:
    """100 * (mean - low) / (high - low); equal references are an error."""
    return F.when(high == low, F.raise_error(F.lit("reference scores are equal")).cast("double")).otherwise(100.0 * (mean - low) / (high - low))


def normalized_std(std: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.raise_error(F.lit("reference scores are equal")).cast("double")).otherwise(100.0 * std / F.abs(high - low))


def triplet(c: Column, name: str) -> list[Column]:
    return [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean")]


def moments(vectors: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation of each dimension, from sums; a deviation below 1e-6 counts as 1."""
    long = vectors.select(*by, F.posexplode(value).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    m = long.groupBy(*by, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    var = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    return m.select(*by, "dim", "n", (F.col("s") / F.col("n")).alias("mean"), F.when(F.sqrt(var) < 1e-6, 1.0).otherwise(F.sqrt(var)).alias("std"))


def histogram(rows: DataFrame, key: str, domain: DataFrame) -> DataFrame:
    """Counts over a whole domain of values, zeros included."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return domain.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def size_estimate(samples: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Bytes of all steps from the bytes of sampled ones, and steps.

    ``samples``: key, steps, bytes; ``totals``: key, steps.
    """
    s = samples.groupBy(key).agg(F.sum("steps").alias("sampled_steps"), F.sum("bytes").alias("sampled_bytes"))
    out = totals.select(key, F.col("steps").alias("target_steps")).join(s, key)
    return out.withColumn("bytes", F.ceil(F.try_divide(F.col("sampled_bytes") * F.col("target_steps"), F.col("sampled_steps"))))


def round_batches(parts: DataFrame, world: int, batch: int) -> DataFrame:
    """Batches that each rank runs in a round: the largest of the round's parts, and samples that fill up to it.

    ``parts``: part (0, 1, ...), samples.
    """
    p = parts.withColumn("round", F.floor(F.col("part") / world)).withColumn("batches", F.ceil(F.col("samples") / batch))
    r = p.groupBy("round").agg(F.max("batches").alias("batches"), F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("parts"))
    return r.withColumn("padding", F.col("batches") * batch * F.col("parts") - F.col("samples"))


def success_requirement(episodes: Column, wins: Column, target: int, least_rate: float) -> Column:
    return (episodes >= target) & (F.coalesce(F.try_divide(wins, episodes), F.lit(0.0)) >= least_rate)


def attempt_budget(target: int, least_rate: float, limit: int | None = None) -> int:
    """Attempts that a target needs at the least rate of success, or the given limit."""
    import math

    if limit is not None:
        if limit < target:
            raise ValueError("fewer attempts than episodes asked for")
        return limit
    return target if least_rate <= 0 else max(target, math.ceil(target / least_rate))


def distance_stats(points: DataFrame, by: Sequence[str], group: Sequence[str], distance: Column) -> DataFrame:
    """The least distance of each episode, and mean, least and median of those by group."""
    each = points.groupBy(*by).agg(F.min(distance).alias("d"))
    return each.groupBy(*group).agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.median("d").alias("median"))


def mean_parts(batches: DataFrame, by: Sequence[str], parts: str) -> DataFrame:
    """Mean of each named part over batches whose parts are a map."""
    return batches.select(*by, F.explode(parts).alias("part", "value")).groupBy(*by, "part").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("batches"))


def last_by(value: str, order: str) -> Column:
    return F.max_by(value, order)


def signs(c: Column) -> list[Column]:
    return [F.count_if(c > 0).alias("positive"), F.count_if(c < 0).alias("negative"), F.count_if(c == 0).alias("zero")]


def tail(rows: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
