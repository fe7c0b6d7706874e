"""Experiment studies: run figures, checkpoint selection, plateaus, gates, audits, protocol checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rules of overfitting and of a longer budget.
DECLINES, LEAST_DECLINE, RECOVERY = 2, 0.02, 0.0
WINDOW, TEST_GAIN, TRAIN_GAIN, TEST_DROP = 3, 0.02, 0.03, 0.01


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 and DuckDB have it: by zero it is infinite, zero by zero is NaN; null only for nulls."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def run_figures(rows: DataFrame, by: Sequence[str], step: str, value: str, threshold: float, tail: int = 3) -> DataFrame:
    """Share above a threshold, least value of the tail, and last over first value of each run."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(step)))
    r = rows.withColumn("_back", back)
    return r.groupBy(*by).agg(
        F.avg(F.when(F.col(value) > threshold, 1.0).otherwise(0.0)).alias("positive"),
        F.min(F.when(F.col("_back") <= tail, F.col(value))).alias("tail_min"),
        ratio(F.max_by(value, step), F.min_by(value, step)).alias("decrease"),
    )


def curves(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean train, test and joint success of each step over the seeds, with the seeds' values in order.

    ``records``: by, seed, step, train, test; the seeds are a handful.
    """
    values = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seed", c))), lambda s: s[c])
    g = records.groupBy(*by, "step").agg(F.avg("train").alias("train"), F.avg("test").alias("test"), F.avg((F.col("train") + F.col("test")) / 2).alias("joint"), values("train").alias("train_seeds"), values("test").alias("test_seeds"))
    return g


def overfit_peaks(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first local peak of the test curve that starts a lasting decline: (by, peak_step).

    From the peak the curve falls over two intervals, by two points at least; it never comes back to the peak;
    train doesn't end lower, and two seeds or more end lower on test.
    """
    w = Window.partitionBy(*by).orderBy("step")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = curve.withColumn("_before", F.lag("test").over(w)).withColumn("_best", F.max("test").over(later))
    for i in range(1, DECLINES + 1):
        c = c.withColumn(f"_t{i}", F.lead("test", i).over(w))
    c = c.withColumn("_train_end", F.last("train").over(whole)).withColumn("_seeds_end", F.last("test_seeds").over(whole))
    falls = F.col("_t1") < F.col("test")
    for i in range(2, DECLINES + 1):
        falls = falls & (F.col(f"_t{i}") < F.col(f"_t{i - 1}"))
    lower = F.size(F.filter(F.zip_with("test_seeds", "_seeds_end", lambda p, e: e < p), lambda x: x))
    peak = (
        (F.col("_before").isNull() | (F.col("test") >= F.col("_before")))
        & falls
        & (F.col("test") - F.col(f"_t{DECLINES}") >= LEAST_DECLINE)
        & (F.col("_best") < F.col("test") - RECOVERY)
        & (F.col("_train_end") >= F.col("train"))
        & (lower >= 2)
    )
    return c.filter(peak).groupBy(*by).agg(F.min("step").alias("peak_step"))


def select_checkpoint(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """One step for all seeds: the best joint success up to an overfit peak; ties go to test, then to the earlier step."""
    c = curves(records, by)
    peaks = overfit_peaks(c, by)
    ok = c.join(peaks, list(by), "left").filter(F.col("peak_step").isNull() | (F.col("step") <= F.col("peak_step")))
    best = ok.groupBy(*by).agg(F.max_by(F.struct("step", "train", "test", "joint"), F.struct("joint", "test", -F.col("step"))).alias("b"), F.max("peak_step").alias("peak_step"))
    return best.select(*by, F.col("b.step").alias("selected_step"), "b.train", "b.test", "b.joint", "peak_step")


def budget_extension(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether the last three checkpoints still gain enough to train on, unless the run overfits."""
    c = curves(records, by)
    w = Window.partitionBy(*by).orderBy(F.desc("step"))
    tail = c.withColumn("_b", F.row_number().over(w)).filter(F.col("_b") <= WINDOW)
    at = lambda col, b: F.max(F.when(F.col("_b") == b, F.col(col)))
    seeds = lambda col, b: F.max_by(col, F.when(F.col("_b") == b, 1).otherwise(0))
    up = lambda a, z: F.size(F.filter(F.zip_with(a, z, lambda x, y: y > x), lambda v: v))
    g = tail.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (at("train", 1) - at("train", WINDOW)).alias("train_delta"), (at("test", 1) - at("test", WINDOW)).alias("test_delta"),
        seeds("train_seeds", 1).alias("te"), seeds("train_seeds", WINDOW).alias("ts"), seeds("test_seeds", 1).alias("ee"), seeds("test_seeds", WINDOW).alias("es"),
    )
    g = g.withColumn("train_up", up("ts", "te")).withColumn("test_up", up("es", "ee"))
    test_ok = (F.col("test_delta") >= TEST_GAIN) & (F.col("test_up") >= 2)
    train_ok = (F.col("train_delta") >= TRAIN_GAIN) & (F.col("test_delta") >= -TEST_DROP) & (F.col("train_up") >= 2)
    g = g.join(overfit_peaks(c, by), list(by), "left")
    whole = F.col("n") == WINDOW
    return g.select(
        *by, F.when(whole, F.lit("complete")).otherwise(F.lit("insufficient")).alias("status"), F.when(whole, F.col("train_delta")).alias("train_delta"), F.when(whole, F.col("test_delta")).alias("test_delta"),
        F.coalesce(whole & F.col("peak_step").isNull() & (test_ok | train_ok), F.lit(False)).alias("recommended"),
    )


def early_stop(values: Column, least_step: int, delta: float, patience: int) -> Column:
    """Plateau rule over the (step, value) array of one run, in order: (best, best_step, stop_step).

    Evaluations before ``least_step`` don't count.  The run stops once ``patience`` evaluations in a row
    gain less than ``delta`` on the best; what follows is ignored.
    """
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_step"), F.lit(0).alias("stale"), F.lit(None).cast("long").alias("stop_step"))

    def fold(s: Column, v: Column) -> Column:
        skip = (v["step"] < least_step) | s["stop_step"].isNotNull()
        better = s["best"].isNull() | (v["value"] >= s["best"] + delta)
        stale = F.when(skip, s["stale"]).when(better, 0).otherwise(s["stale"] + 1)
        move = ~skip & better
        return F.struct(
            F.when(move, v["value"]).otherwise(s["best"]).alias("best"), F.when(move, v["step"]).otherwise(s["best_step"]).alias("best_step"), stale.alias("stale"),
            F.when(~skip & ~better & (s["stale"] + 1 >= patience), v["step"]).otherwise(s["stop_step"]).alias("stop_step"),
        )

    return F.aggregate(values, start, fold)


def audit(recorded: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Stored metrics (keys, metric, value) against recomputed ones: missing, extra and differing values."""
    a, b = recorded.select(*keys, "metric", F.col("value").alias("stored")), computed.select(*keys, "metric", F.col("value").alias("found"))
    both = a.join(b, [*keys, "metric"], "full_outer")
    finding = (
        F.when(F.col("found").isNull() & F.col("stored").isNull(), None)
        .when(F.col("stored").isNull(), "not stored")
        .when(F.col("found").isNull(), "not computed")
        .when(F.isnan("stored") | F.isnan("found"), "not finite")
        .when(F.abs(F.col("stored") - F.col("found")) > tolerance, "differs")
    )
    return both.withColumn("finding", finding).filter("finding is not null")


def unpivot(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, metric, value) from columns."""
    return rows.unpivot(list(keys), list(columns), "metric", "value")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """(run, variant, episode fields) from a map of variants to structs with an array of episodes."""
    v = tree.select("run", F.explode("variants").alias("variant", "v"))
    return v.select("run", "variant", F.explode("v.episodes").alias("e")).select("run", "variant", "e.*")


def conformance(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between (run, key, value) tables of settings."""
    e, a = expected.withColumnRenamed("value", "wanted"), actual.withColumnRenamed("value", "found")
    both = e.join(a, ["run", "key"], "full_outer")
    return both.filter(~F.col("wanted").eqNullSafe(F.col("found"))).select("run", "key", "wanted", "found")


def stability(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Verdict on each training run with its reasons: invalid, unstable or stable.

    ``rows``: by, epoch, loss, gradient, spread; an epoch is one row.
    """
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("epoch")))
    r = rows.withColumn("_b", back).withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy("epoch")))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    g = r.groupBy(*by).agg(
        F.bool_or(bad("loss") | bad("gradient")).alias("broken"), F.bool_or(F.col("epoch") != F.col("_pos")).alias("gaps"),
        F.avg(F.when(F.col("gradient") > 0, 1.0).otherwise(0.0)).alias("moving"), F.min(F.when(F.col("_b") <= 3, F.col("spread"))).alias("tail_spread"),
        ratio(F.max_by("loss", "epoch"), F.min_by("loss", "epoch")).alias("ratio"),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("broken"), F.lit("value not finite")), F.when(F.col("gaps"), F.lit("epochs not consecutive")), F.when(F.col("moving") < 0.95, F.lit("gradients vanish")),
            F.when(F.col("tail_spread") < 1e-3, F.lit("actions collapse")), F.when(F.col("ratio") >= 1.0, F.lit("loss does not fall")),
        ),
        lambda x: x.isNotNull(),
    )
    verdict = F.when(F.col("broken") | F.col("gaps"), "invalid").when(F.size("reasons") > 0, "unstable").otherwise("stable")
    return g.withColumn("reasons", reasons).select(*by, verdict.alias("verdict"), F.array_join("reasons", "; ").alias("reasons"))


def markdown(rows: DataFrame, columns: Sequence[str], limit: int = 1000) -> str:
    """A report table; reports are of a bounded number of rows."""
    got = rows.select(*columns).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError("too many rows for a report")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got])
