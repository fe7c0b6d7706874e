"""Deterministic sampling, splitting, sharding and assignment.

Randomness is a hash of a key and a seed, so a draw doesn't depend on the order or the
partitioning of rows.  Where a row's place among others matters, ranks are taken by
group; no operator ranks all rows in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 1024  # of a distribution that draws meet choices by


def hash_key(*parts: Column | str | int) -> Column:
    """Hex SHA-256 of the parts joined by colons; fixed-width hex orders like the number."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *cols), 256)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of the hash."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def split(rows: DataFrame, by: Sequence[str], key: str, seed: int, train_ratio: float, keep: int | None = None) -> DataFrame:
    """Rows in hash order by group: the first ``keep`` are sampled, floor(ratio) of those train, the rest val."""
    w = Window.partitionBy(*by)
    order = w.orderBy(hash_key(*(F.col(b) for b in by), seed, F.col(key)), key)
    n = F.count(F.lit(1)).over(w)
    target = n if keep is None else F.least(n, F.lit(keep).cast("long"))
    r = rows.withColumn("_r", F.row_number().over(order)).withColumn("_t", target).filter("_r <= _t")
    return r.withColumn("split", F.when(F.col("_r") <= F.floor(F.col("_t") * train_ratio), "train").otherwise("val")).drop("_r", "_t")


def keep_overrides(groups: DataFrame, overrides: DataFrame, key: str, default: int) -> DataFrame:
    """Rows to keep by group: its override, or the default."""
    return groups.join(overrides, key, "left").select(key, F.coalesce("keep", F.lit(default)).alias("keep"))


def first_by_hash(rows: DataFrame, by: Sequence[str], key: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` rows of each group in hash order."""
    order = Window.partitionBy(*by).orderBy(hash_key(seed, *(F.col(b) for b in by), F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def split_groups(rows: DataFrame, group: str, seed: int, ratio: float) -> DataFrame:
    """Whole groups go to train or val by a hash of the group, so no group is in both."""
    return rows.withColumn("split", F.when(uniform(seed, F.col(group)) < ratio, "train").otherwise("val"))


def round_robin(rows: DataFrame, by: Sequence[str], key: str, seed: int, parts: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(hash_key(*(F.col(b) for b in by), seed, F.col(key)), key)
    return rows.withColumn("part", (F.row_number().over(order) - 1) % parts)


def step_shards(episodes: DataFrame, by: Sequence[str], key: str, seed: int, parts: int) -> DataFrame:
    """Step-balanced shards that may split episodes: (by, key, part, start_t, end_t).

    Episodes stand in hash order; shard i of T steps ends at (i + 1) * (T div P) + min(i + 1, T mod P).
    Each episode names the shards it touches from its own offsets, so no table of
    shards is joined.  More parts than steps are an error.
    """
    w = Window.partitionBy(*by)
    order = w.orderBy(hash_key(*(F.col(b) for b in by), seed, F.col(key)), key)
    e = episodes.withColumn("_pe", F.sum("n_steps").over(order)).withColumn("_total", F.sum("n_steps").over(w))
    e = e.withColumn("_ps", F.col("_pe") - F.col("n_steps")).withColumn("_base", F.floor(F.col("_total") / parts)).withColumn("_more", F.col("_total") % parts)
    e = e.withColumn("_ok", F.when(F.col("_base") == 0, F.raise_error(F.lit("more parts than steps")).cast("int")).otherwise(1))
    big = F.col("_more") * (F.col("_base") + 1)  # the first shards have one step more
    of = lambda x: F.when(x < big, F.floor(x / (F.col("_base") + 1))).otherwise(F.col("_more") + F.floor((x - big) / F.col("_base")))
    e = e.filter("n_steps > 0 and _ok = 1").withColumn("part", F.explode(F.sequence(of(F.col("_ps")), of(F.col("_pe") - 1))))
    start = F.col("part") * F.col("_base") + F.least("part", "_more")
    end = (F.col("part") + 1) * F.col("_base") + F.least(F.col("part") + 1, F.col("_more"))
    return e.select(*by, key, "part", (F.greatest(start, F.col("_ps")) - F.col("_ps")).alias("start_t"), (F.least(end, F.col("_pe")) - F.col("_ps")).alias("end_t"))


def round_order(rounds: DataFrame, epoch: int, seed: int) -> DataFrame:
    """A seeded order of the few rounds of an epoch."""
    return rounds.withColumn("position", F.row_number().over(Window.orderBy(hash_key(seed, epoch, F.col("round")), "round")) - 1)


def deal_ranks(items: DataFrame, key: str, world: int) -> DataFrame:
    """(key, rank): the distinct keys of a dimension, in order, dealt to ranks in turn."""
    if world < 1:
        raise ValueError("at least one rank is needed")
    at = F.row_number().over(Window.orderBy(key)) - 1
    return items.select(key).distinct().select(key, F.pmod(at, F.lit(world)).cast("long").alias("rank"))


def assign_ranks(items: Sequence[str], world: int) -> list[tuple[str, int]]:
    """Items dealt to ranks in turn."""
    if world < 1:
        raise ValueError("at least one rank is needed")
    return [(x, i % world) for i, x in enumerate(items)]


def inverse_size_weights(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """A weight of 1 / n for each row of a group of n rows; the sizes are counted apart and joined, so a large group is no single task's."""
    n = rows.groupBy(*by).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return rows.join(n, list(by))


def weighted_draws(choices: DataFrame, weight: str, order: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement from a bounded table of choices, by an inverse cumulative distribution.

    Each draw's uniform number falls into one choice's half-open interval; choices without weight are never drawn.
    """
    w = Window.orderBy(*order)
    c = choices.filter(F.col(weight) > 0).withColumn("_hi", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("_lo", F.col("_hi") - F.col(weight))
    total = c.agg(F.max("_hi").alias("_total"))  # one row
    draws = choices.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("u", uniform(seed, F.col("draw"))).crossJoin(F.broadcast(total))
    # both sides meet by buckets of the distribution; an interval is in every bucket that it may touch
    at = lambda x, by: F.floor(F.col(x) / F.col("_total") * BUCKETS + by)
    c = c.crossJoin(F.broadcast(total)).withColumn("_b", F.explode(F.sequence(at("_lo", -1e-6), at("_hi", 1e-6)))).drop("_total")
    x = F.col("u") * F.col("_total")
    met = draws.withColumn("_b", F.floor(F.col("u") * BUCKETS)).join(c, "_b").filter((x >= F.col("_lo")) & (x < F.col("_hi")))
    return met.drop("_hi", "_lo", "_total", "u", "_b")


def pad_rows(n_rows: int, size: int, seed: int) -> list[int]:
    """Row numbers of a shard filled up to ``size``: each row once in a seeded order, then seeded repeats."""
    import hashlib

    if n_rows <= 0:
        raise ValueError("nothing to pad")
    h = lambda *p: hashlib.sha256(":".join(map(str, p)).encode()).hexdigest()
    return sorted(range(n_rows), key=lambda i: (h(seed, i), i))[:size] + [int(h(seed, "pad", i), 16) % n_rows for i in range(size - n_rows)]


def pad_groups(rows: DataFrame, by: Sequence[str], key: str, seed: int, size: Column) -> DataFrame:
    """(by, position, key): each group's rows once in a seeded order, then seeded repeats up to ``size`` rows.

    ``size`` is a column expression over n, the rows of the group.  Larger groups stay as they are.
    """
    order = Window.partitionBy(*by).orderBy(hash_key(*(F.col(b) for b in by), seed, F.col(key)), key)
    placed = rows.select(*by, key).withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("size", size).filter("size > n")
    more = n.withColumn("place", F.explode(F.sequence("n", F.col("size") - 1)))
    more = more.withColumn("position", F.floor(uniform(*(F.col(b) for b in by), seed, "pad", F.col("place")) * F.col("n")))
    more = more.join(placed, [*by, "position"]).select(*by, F.col("place").alias("position"), key)
    return placed.select(*by, "position", key).unionByName(more)


def split_rows(targets: DataFrame, target: str, workers: int) -> DataFrame:
    """A row for each worker with its share of ``target``; the first ones take the remainder."""
    each = targets.withColumn("worker", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(workers - 1).cast("long"))))
    return each.withColumn("share", F.floor(F.col(target) / workers) + F.when(F.col("worker") < F.col(target) % workers, 1).otherwise(0))


def weighted_top(rows: DataFrame, by: Sequence[str], key: str, weight: str, seed: int, n: int) -> DataFrame:
    """A weighted sample of ``n`` rows by group without replacement: the least -ln(u) / w come first."""
    u = F.greatest(uniform(seed, *(F.col(b) for b in by), F.col(key)), F.lit(2.0**-53))
    race = F.when(F.col(weight) > 0, -F.log(u) / F.col(weight)).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*by).orderBy("_race", key)
    return rows.withColumn("_race", race).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_race", "_r")


def permutation_cycle(items: DataFrame, by: Sequence[str], key: str, seed: int, episodes: DataFrame, episode: str) -> DataFrame:
    """Each episode's item: episode modulo n in the items' seeded order."""
    w = Window.partitionBy(*by)
    p = items.withColumn("_pos", F.row_number().over(w.orderBy(hash_key(seed, F.col(key)), key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    n = p.select(*by, "_n").distinct()
    return episodes.join(n, list(by)).withColumn("_pos", F.col(episode) % F.col("_n")).join(p.drop("_n"), [*by, "_pos"]).drop("_n", "_pos")


def probabilities(rows: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Weights as shares of their group; groups without weight share evenly."""
    s = rows.groupBy(*by).agg(F.sum(weight).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return rows.join(s, list(by)).withColumn("probability", F.when(F.col("_s") > 0, F.col(weight) / F.col("_s")).otherwise(1.0 / F.col("_n"))).drop("_s", "_n")


def relabel_goals(steps: DataFrame, seed: int, p_current: float, p_future: float, discount: float | None, keys: Sequence[str] = ("variant", "episode_idx")) -> DataFrame:
    """A goal step for every step: itself, a later step of its episode, or any step of its variant.

    Later steps are drawn evenly, or geometrically with a discount and cut at the episode's end.
    Columns: goal_kind, goal_t (in the episode) and goal_u, the draw that names a random step of the variant.
    """
    last = steps.groupBy(*keys).agg(F.max("t").alias("_last"))
    s = steps.join(last, list(keys))
    draw = lambda tag: uniform(seed, tag, *(F.col(k) for k in keys), F.col("t"))
    kind = F.when(draw("kind") < p_current, "current").when(draw("kind") < p_current + p_future, "future").otherwise("random")
    if discount is None:
        ahead = F.col("t") + 1 + F.floor(draw("step") * (F.col("_last") - F.col("t")))
    else:
        ahead = F.col("t") + 1 + F.floor(F.log(F.greatest(1 - draw("step"), F.lit(2.0**-53))) / F.log(F.lit(discount)))
    s = s.withColumn("goal_kind", kind)
    goal = F.when(F.col("goal_kind") == "current", F.col("t")).when(F.col("goal_kind") == "future", F.least(ahead, F.col("_last")))
    return s.withColumn("goal_t", goal.cast("long")).withColumn("goal_u", F.when(F.col("goal_kind") == "random", draw("goal"))).drop("_last")


def split_target(target: int, workers: int) -> list[int]:
    return [target // workers + (i < target % workers) for i in range(workers)]


def bootstrap_means(pairs: DataFrame, seeds: Sequence[int], variants: Sequence[str], per_variant: int, replicates: int, seed: int) -> DataFrame:
    """Replicates of a paired difference, resampled by seed, then variant, then episode.

    ``pairs``: seed, variant, pos (0 .. per_variant - 1), diff.  A bounded table of audited
    episodes is broadcast; the replicates are spread.
    """
    spark = pairs.sparkSession
    s = spark.range(replicates).select(F.col("id").alias("replicate"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1)))).withColumn("seed", F.element_at(F.array(*map(F.lit, seeds)), F.floor(uniform(seed, "s", F.col("replicate"), F.col("i")) * len(seeds)).cast("int") + 1))
    s = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(variants) - 1)))).withColumn("variant", F.element_at(F.array(*map(F.lit, variants)), F.floor(uniform(seed, "v", F.col("replicate"), F.col("i"), F.col("j")) * len(variants)).cast("int") + 1))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_variant - 1)))).withColumn("pos", F.floor(uniform(seed, "e", F.col("replicate"), F.col("i"), F.col("j"), F.col("k")) * per_variant))
    return s.join(F.broadcast(pairs), ["seed", "variant", "pos"]).groupBy("replicate").agg(F.avg("diff").alias("mean"))


def bootstrap_groups(pairs: DataFrame, by: str, replicates: int, seed: int) -> DataFrame:
    """(by, replicate, mean): replicates of a paired difference over all episodes of each group.

    ``pairs``: by, seed, variant, diff; a null difference is no episode.  A replicate draws as many seeds as the group has,
    and as many variants, which all its seeds share; from each cell drawn it takes as many episodes as that cell has,
    with replacement, and its mean is over all of them.  A cell without episodes gives none, and a replicate
    without any is drawn again.  How often each value of a cell is drawn is one multinomial number, so a cell is
    held as the counts of its distinct values (three, for flags): one row for each group is broadcast.
    """
    cell = pairs.filter("diff is not null").groupBy(by, "seed", "variant", F.col("diff").cast("double").alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    whole = cell.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seed", "variant", "diff", "n"))).alias("cells"))
    size = 100

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values: dict = {}
                for c in row["cells"]:
                    values.setdefault((c["seed"], c["variant"]), []).append((c["diff"], c["n"]))
                cells = {k: (n := sum(x for _, x in v), np.array([x for _, x in v]) / n, np.array([d for d, _ in v])) for k, v in values.items()}
                seeds, variants = (list(dict.fromkeys(k[i] for k in cells)) for i in range(2))
                variants.sort()
                at, means = range(row["block"] * size, min(row["block"] * size + size, replicates)), []
                for r in at:
                    rng = np.random.Generator(np.random.Philox(key=int(hashlib.sha256(f"{seed}:{row[by]}:{r}".encode()).hexdigest()[:32], 16)))
                    drawn: list = []
                    while not drawn:
                        s, v = rng.integers(len(seeds), size=len(seeds)), rng.integers(len(variants), size=len(variants))
                        drawn = [c for i in s for j in v if (c := cells.get((seeds[i], variants[j])))]
                    means.append(sum(float(rng.multinomial(n, p) @ d) for n, p, d in drawn) / sum(n for n, _, _ in drawn))
                yield pa.RecordBatch.from_arrays([pa.array([row[by]] * len(at), batch.schema.field(by).type), pa.array(at, pa.int64()), pa.array(means, pa.float64())], [by, "replicate", "mean"])

    blocks = pairs.sparkSession.range(-(-replicates // size)).select(F.col("id").alias("block"))
    kind = pairs.schema[by].dataType.simpleString()
    return blocks.crossJoin(F.broadcast(whole)).mapInArrow(draw, f"`{by}` {kind}, replicate long, mean double")


def interval(replicates: DataFrame, value: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """2.5 and 97.5 per cent quantiles with linear interpolation, over a fixed number of replicates."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"), F.count(F.lit(1)).alias("replicates")).select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates")
