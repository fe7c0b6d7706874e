"""Episode preparation: event alignment, success filters, truncation, validation, steps and transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_events(flags: Column, n: Column) -> Column:
    """An event vector as one flag for each of ``n`` transitions.

    With at least n + 1 values the first, which belongs to the initial state, is
    left out; with n or more the first n are taken; a shorter vector is filled up with
    false.  A null vector is all false.
    """
    flags = F.coalesce(flags, F.array().cast("array<boolean>"))
    fill = F.transform(F.sequence(F.lit(1), F.greatest(n - F.size(flags), F.lit(1))), lambda _: F.lit(False))
    return F.when(n <= 0, F.array().cast("array<boolean>")).when(F.size(flags) > n, F.slice(flags, 2, n)).when(F.size(flags) == n, flags).otherwise(F.concat(flags, fill))


def slice_aligned(values: Column, old: Column, new: Column) -> Column:
    """Cut a field of length T or T + 1 to a shorter episode; other lengths stay."""
    return F.when(F.size(values) == old + 1, F.slice(values, 1, new + 1)).when(F.size(values) == old, F.slice(values, 1, new)).otherwise(values)


def mark_last(flags: Column) -> Column:
    """Set the last truncation flag."""
    return F.when(F.size(flags) > 0, F.concat(F.slice(flags, 1, F.size(flags) - 1), F.array(F.lit(True)))).otherwise(flags)


def fallen(z: Column, quat: Sequence[Column]) -> Column:
    """Whether a torso state is a fall: low and upside down, or lower still without a valid attitude.

    ``quat`` is (w, x, y, z).  A height that isn't finite is no fall.
    """
    w, x, y, q = quat
    norm = F.sqrt(w * w + x * x + y * y + q * q)
    sound = F.coalesce(~F.isnan(norm) & (F.abs(norm - 1.0) <= 1e-3), F.lit(False))
    finite = F.coalesce(~F.isnan(z) & (F.abs(z) < float("inf")), F.lit(False))
    up = 1 - 2 * (x * x + y * y)
    return finite & F.when(sound, (z < 0.35) & (up < 0)).otherwise(z < 0.30)


_EP = ("variant", "episode_idx")


def keep_successful(steps: DataFrame, flag: str = "success", keys: Sequence[str] = _EP) -> DataFrame:
    """Steps of the episodes in which the flag is ever set."""
    won = steps.filter(F.col(flag)).select(*keys).distinct()
    return steps.join(won, list(keys), "left_semi")


def truncate_at_event(steps: DataFrame, event: Column, holding: int = 0, keys: Sequence[str] = _EP) -> DataFrame:
    """Cut every episode after the first event and ``holding`` further steps; ``truncated`` marks a cut episode's last step.

    Episodes without an event stay whole.
    """
    first = steps.filter(event).groupBy(*keys).agg(F.min("t").alias("first_t"))
    last = steps.groupBy(*keys).agg(F.max("t").alias("last_t"))
    bound = last.join(first, list(keys), "left").select(*keys, "last_t", F.least(F.col("last_t"), F.coalesce(F.col("first_t") + holding, F.col("last_t"))).alias("end_t"))
    out = steps.join(bound, list(keys)).filter(F.col("t") <= F.col("end_t"))
    return out.withColumn("truncated", (F.col("t") == F.col("end_t")) & (F.col("end_t") < F.col("last_t"))).drop("last_t", "end_t")


def filter_truncate_refilter(steps: DataFrame, holding: int = 0) -> DataFrame:
    """Keep successful episodes, cut at the first success or fall, and keep those whose success survived the cut."""
    kept = keep_successful(steps)
    return keep_successful(truncate_at_event(kept, F.col("success") | F.col("fall"), holding))


def first_event(steps: DataFrame, event: Column, keys: Sequence[str] = _EP) -> DataFrame:
    """First step of the event for each episode, null where there is none."""
    return steps.groupBy(*keys).agg(F.min(F.when(event, F.col("t"))).alias("first_t"), F.count(F.lit(1)).alias("n_steps"))


def history(value: Column, n: int, stride: int, keys: Sequence[str] = _EP) -> Column:
    """Up to ``n`` earlier values, one step back and then every ``stride`` steps, oldest first."""
    w = Window.partitionBy(*keys).orderBy("t")
    back = [1 + k * stride for k in range(n)]
    past = F.array(*(F.struct(F.lit(b).alias("steps_ago"), F.lag(value, b).over(w).alias("value"), F.lag(F.lit(1), b).over(w).alias("there")) for b in reversed(back)))
    return F.transform(F.filter(past, lambda p: p["there"].isNotNull()), lambda p: F.struct(p["steps_ago"].alias("steps_ago"), p["value"].alias("value")))


def transitions(steps: DataFrame, keys: Sequence[str] = _EP) -> DataFrame:
    """Next reward (zero at the end), reward to go, and the terminal flag of the last step."""
    w = Window.partitionBy(*keys).orderBy("t")
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return steps.select(
        "*",
        F.coalesce(F.lead("reward").over(w), F.lit(0.0)).alias("next_reward"),
        F.sum("reward").over(rest).alias("reward_to_go"),
        F.lead("t").over(w).isNull().alias("is_last"),
    ).withColumn("terminal", F.when(F.col("is_last") & F.col("success"), 1.0).otherwise(0.0))


def explode_prompts(steps: DataFrame, templates: DataFrame) -> DataFrame:
    """One sample for each step and template; the templates are a handful and are broadcast."""
    return steps.crossJoin(F.broadcast(templates))


def in_segments(steps: DataFrame, segments: DataFrame, keys: Sequence[str] = _EP) -> DataFrame:
    """Steps within [start_t, end_t) of their episode's segments; history must be made before this cut."""
    return steps.join(segments, list(keys)).filter((F.col("t") >= F.col("start_t")) & (F.col("t") < F.col("end_t")))


def violations(steps: DataFrame, keys: Sequence[str] = _EP) -> DataFrame:
    """Broken rules of an episode table: (keys, rule, n).

    Rewards must be finite, steps must count up from 0, and a terminal flag may
    stand on the last step only.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    s = steps.withColumn("pos", F.row_number().over(w) - 1).withColumn("later", F.lead("t").over(w))
    bad = F.array(
        F.when(F.col("reward").isNull() | F.isnan("reward") | (F.abs("reward") == float("inf")), F.lit("reward not finite")),
        F.when(F.col("t") != F.col("pos"), F.lit("step out of order")),
        F.when(F.col("terminated") & F.col("later").isNotNull(), F.lit("terminated before the end")),
        F.when(F.col("terminated") & F.col("truncated"), F.lit("terminated and truncated")),
    )
    return s.select(*keys, F.explode(F.filter(bad, lambda r: r.isNotNull())).alias("rule")).groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("n"))


def constant_slots(vectors: DataFrame, value: str, group: str) -> DataFrame:
    """Slots of a vector that never change within a group: (group, slot, value)."""
    long = vectors.select(group, F.posexplode(value).alias("slot", "v"))
    seen = long.groupBy(group, "slot").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), F.count(F.lit(1)).alias("rows"))
    return seen.filter((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("rows"))).select(group, "slot", F.col("lo").alias("value"))
