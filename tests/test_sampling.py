import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stridelake.operators import ordered as O
from stridelake.operators import sampling as S
from stridelake.operators import selection as L


def episodes(spark, lengths, variant="v"):
    return spark.createDataFrame([(variant, i, n) for i, n in enumerate(lengths)], "variant string, episode_idx long, n_steps long")


def cut_points(total, parts):
    """Ends of the shards by the sequential rule: each takes its share of what is left, rounded up."""
    at, out = 0, []
    for i in range(parts):
        at += math.ceil((total - at) / (parts - i))
        out.append(at)
    return out


@pytest.mark.parametrize("lengths,parts", [([3, 5, 2], 4), ([10], 3), ([1] * 7, 7), ([3, 5, 2, 7, 4, 6, 8, 1, 9, 10], 4), ([50, 1, 1], 6)])
def test_shards_cover_every_step_once(spark, lengths, parts):
    got = S.step_shards(episodes(spark, lengths), ["variant"], "episode_idx", 7, parts).collect()
    steps = Counter((r.episode_idx, t) for r in got for t in range(r.start_t, r.end_t))
    assert steps == Counter((i, t) for i, n in enumerate(lengths) for t in range(n))
    size = Counter()
    for r in got:
        size[r.part] += r.end_t - r.start_t
    ends = cut_points(sum(lengths), parts)
    assert [size[p] for p in range(parts)] == [b - a for a, b in zip([0, *ends], ends, strict=False)]


def test_a_split_episode(spark):
    got = sorted((r.start_t, r.end_t) for r in S.step_shards(episodes(spark, [10]), ["variant"], "episode_idx", 7, 3).collect())
    assert got == [(0, 4), (4, 7), (7, 10)]


def test_too_few_steps(spark):
    with pytest.raises(Exception, match="more parts than steps"):
        S.step_shards(episodes(spark, [2]), ["variant"], "episode_idx", 7, 3).collect()


def test_split_is_disjoint_repeatable_and_independent_of_partitions(spark):
    e = episodes(spark, [1] * 50)
    one = {(r.episode_idx, r.split) for r in S.split(e, ["variant"], "episode_idx", 3, 0.8, 40).collect()}
    two = {(r.episode_idx, r.split) for r in S.split(e.repartition(7), ["variant"], "episode_idx", 3, 0.8, 40).collect()}
    assert one == two and len(one) == len({i for i, _ in one}) == 40
    assert Counter(s for _, s in one) == {"train": 32, "val": 8}
    assert one != {(r.episode_idx, r.split) for r in S.split(e, ["variant"], "episode_idx", 4, 0.8, 40).collect()}


def test_groups_stay_whole(spark):
    d = spark.range(1000).withColumn("g", F.col("id") % 50)
    s = S.split_groups(d, "g", 1, 0.7)
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert 400 < s.filter("split = 'train'").count() < 900


def test_padding():
    got = S.pad_rows(3, 8, 7)
    assert sorted(got[:3]) == [0, 1, 2] and len(got) == 8 and set(got) <= {0, 1, 2}
    assert got == S.pad_rows(3, 8, 7) and len(S.pad_rows(5, 3, 1)) == 3
    with pytest.raises(ValueError):
        S.pad_rows(0, 3, 1)


def test_zero_weights_are_never_drawn(spark):
    c = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)], "idx int, w double")
    assert [r.idx for r in S.weighted_draws(c, "w", ["idx"], 10, 7).collect()] == [1] * 10
    assert S.weighted_top(c.withColumn("g", F.lit(0)), ["g"], "idx", "w", 7, 1).first().idx == 1


def test_draws_follow_the_weights(spark):
    c = spark.createDataFrame([(0, 1.0), (1, 3.0)], "idx int, w double")
    n = Counter(r.idx for r in S.weighted_draws(c, "w", ["idx"], 4000, 7).collect())
    assert n[0] + n[1] == 4000 and 2850 < n[1] < 3150


def test_weighted_sample_without_replacement_follows_the_weights(spark):
    d = spark.range(2000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("w", F.when(F.col("k") == 1, 4.0).otherwise(1.0))
    n = Counter(r.k for r in S.weighted_top(d, ["g"], "k", "w", 3, 1).collect())
    assert 1520 < n[1] < 1680


def test_goals_lie_ahead_and_in_their_shares(spark):
    s = spark.range(5000).select((F.col("id") % 2).alias("variant"), F.floor(F.col("id") / 50).alias("episode_idx"), (F.col("id") % 50).alias("t"))
    s = s.withColumn("variant", F.lit(0))
    for discount in (None, 0.9):
        g = S.relabel_goals(s, 1, 0.2, 0.5, discount).collect()
        n = Counter(r.goal_kind for r in g)
        assert 800 < n["current"] < 1200 and 2300 < n["future"] < 2700
        assert all(r.goal_t == r.t for r in g if r.goal_kind == "current")
        assert all(r.t < r.goal_t <= 49 or r.t == r.goal_t == 49 for r in g if r.goal_kind == "future")
        assert all(r.goal_t is None and 0 <= r.goal_u < 1 for r in g if r.goal_kind == "random")
    ahead = [r.goal_t - r.t for r in g if r.goal_kind == "future" and r.t < 10]
    assert 8 < sum(ahead) / len(ahead) < 12


def test_bootstrap(spark):
    rows = [(s, v, p, 0.0) for s in range(3) for v in "ab" for p in range(5)]
    zero = S.interval(S.bootstrap_means(spark.createDataFrame(rows, "seed int, variant string, pos long, diff double"), [0, 1, 2], ["a", "b"], 5, 200, 1)).first()
    assert (zero.mean, zero.low, zero.high, zero.replicates) == (0.0, 0.0, 0.0, 200)
    rows = [(s, v, p, float((s + p) % 2) + 1) for s, v, p, _ in rows]
    df = spark.createDataFrame(rows, "seed int, variant string, pos long, diff double")
    a, b = (S.interval(S.bootstrap_means(df, [0, 1, 2], ["a", "b"], 5, 300, 1)).first() for _ in range(2))
    assert a == b and 1 < a.low < a.mean < a.high < 2


def test_quantiles_are_linear(spark):
    r = S.interval(spark.range(11).select(F.col("id").cast("double").alias("mean"))).first()
    assert (round(r.low, 9), round(r.high, 9)) == (0.25, 9.75)


def test_small_rules():
    assert S.split_target(10, 4) == [3, 3, 2, 2]
    assert S.assign_ranks(["a", "b", "c"], 2) == [("a", 0), ("b", 1), ("c", 0)]
    assert (O.pool_size(41, percent=5), O.pool_size(41, percent=0.05), O.pool_size(41, n=99), O.pool_size(0, n=3)) == (3, 3, 41, 0)
    with pytest.raises(ValueError, match="overlapping"):
        L.normalize_ranges([(0, 5), (4, 8)], 0, 10)
    for bad in ([(3, 3)], [(-1, 4)], [(5, 11)]):
        with pytest.raises(ValueError):
            L.normalize_ranges(bad, 0, 10)
    assert L.resolve_names("except", ["b"], ["a", "b", "c"]) == ["a", "c"]
    assert L.resolve_names("all", [], ["a", "b"]) == ["a", "b"]
    for mode, names in (("single", ["a", "a"]), ("single", ["x"]), ("single", ["a", "b"]), ("except", ["a", "b"]), ("odd", ["a"])):
        with pytest.raises(ValueError):
            L.resolve_names(mode, names, ["a", "b"])


def test_pareto_equals_pairwise_comparison(spark):
    rows = [(i, i % 3, float((i * 7) % 11), float((i * 5) % 13)) for i in range(120)]
    want = {i for i, g, c, v in rows if not any(h == g and d <= c and w >= v and (d < c or w > v) for _, h, d, w in rows)}
    df = spark.createDataFrame(rows, "id int, g int, cost double, gain double")
    assert {r.id for r in O.pareto(df, ["g"], "cost", "gain").collect()} == want


def test_overlaps_equal_pairwise_comparison(spark):
    p = [(i, (i * 37) % 200, (i * 37) % 200 + (i * 13) % 60) for i in range(40)]
    s = [(j, j * 17, j * 17 + 17 + j % 5) for j in range(14)]
    want = {(i, j, max(a, c), min(b, d)) for i, a, b in p for j, c, d in s if a < d and c < b and a < b}
    got = O.interval_overlap(spark.createDataFrame(p, "i int, ps long, pe long"), spark.createDataFrame(s, "j int, ss long, se long"), 23)
    rows = [(r.i, r.j, r.lo, r.hi) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_spaced_samples_have_both_ends(spark):
    d = spark.range(10).withColumn("g", F.lit(0))
    assert sorted(r.id for r in O.linspace(d, ["g"], ["id"], 4).collect()) == [0, 3, 6, 9]
    assert O.linspace(d, ["g"], ["id"], 99).count() == 10
    assert [r.id for r in O.linspace(d, ["g"], ["id"], 1).collect()] == [0]
