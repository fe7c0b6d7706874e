import math

import pytest
from pyspark.sql import functions as F

from stridelake.operators import episodes as E

STEP = "variant long, episode_idx long, t long, reward double, success boolean, fall boolean"


def steps(spark, episodes):
    """Episodes as strings: s success, f fall, b both, . neither."""
    return spark.createDataFrame([(0, i, t, float(t), c in "sb", c in "fb") for i, e in enumerate(episodes) for t, c in enumerate(e)], STEP)


def lengths(df):
    return {r.episode_idx: r.n for r in df.groupBy("episode_idx").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("flags,n,want", [([0, 1, 0, 1], 3, [1, 0, 1]), ([0, 1, 0], 3, [0, 1, 0]), ([1], 3, [1, 0, 0]), ([], 2, [0, 0]), (None, 2, [0, 0]), ([1, 1], 0, []), ([0, 0, 0, 0, 1], 3, [0, 0, 0])])
def test_event_vectors_are_aligned(spark, flags, n, want):
    df = spark.createDataFrame([([bool(x) for x in flags] if flags is not None else None, n)], "f array<boolean>, n int")
    assert df.select(E.align_events(F.col("f"), F.col("n"))).first()[0] == [bool(x) for x in want]


def test_fields_are_cut_by_their_length(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3], [9])], "a array<int>, b array<int>, c array<int>")
    got = df.select(*(E.slice_aligned(F.col(c), F.lit(3), F.lit(2)) for c in "abc")).first()
    assert list(got) == [[1, 2, 3], [1, 2], [9]]


def test_last_truncation_flag(spark):
    df = spark.createDataFrame([([False, False],), ([],)], "f array<boolean>")
    assert [r[0] for r in df.select(E.mark_last(F.col("f"))).collect()] == [[False, True], []]


@pytest.mark.parametrize(
    "z,quat,want",
    [(0.34, (0.0, 1.0, 0.0, 0.0), True), (0.34, (1.0, 0.0, 0.0, 0.0), False), (0.36, (0.0, 1.0, 0.0, 0.0), False), (0.29, (1.0, 0.0, 0.0, 0.0), False), (0.29, (0.0, 0.0, 0.0, 0.0), True), (0.31, (0.0, 0.0, 0.0, 0.0), False), (0.29, (math.nan, 0.0, 0.0, 0.0), True), (math.nan, (0.0, 1.0, 0.0, 0.0), False), (-math.inf, (0.0, 1.0, 0.0, 0.0), False)],
)
def test_falls(spark, z, quat, want):
    assert spark.range(1).select(E.fallen(F.lit(z), [F.lit(q) for q in quat])).first()[0] is want


def test_filter_truncate_refilter(spark):
    s = steps(spark, ["..s..", ".f.s.", ".....", "s", "..b.", ".fs"])
    assert lengths(E.keep_successful(s)) == {0: 5, 1: 5, 3: 1, 4: 4, 5: 3}
    assert lengths(E.truncate_at_event(s, F.col("success"), 1)) == {0: 4, 1: 5, 2: 5, 3: 1, 4: 4, 5: 3}
    assert lengths(E.filter_truncate_refilter(s)) == {0: 3, 3: 1, 4: 3}
    cut = E.truncate_at_event(s, F.col("success")).filter("truncated").select("episode_idx", "t").collect()
    assert sorted(map(tuple, cut)) == [(0, 2), (1, 3), (4, 2)]


def test_history_looks_back_by_strides(spark):
    h = steps(spark, ["......"]).withColumn("h", E.history(F.col("reward"), 3, 2)).orderBy("t").collect()
    assert [[(p.steps_ago, p.value) for p in r.h] for r in h] == [[], [(1, 0.0)], [(1, 1.0)], [(3, 0.0), (1, 2.0)], [(3, 1.0), (1, 3.0)], [(5, 0.0), (3, 2.0), (1, 4.0)]]


def test_transitions(spark):
    t = E.transitions(steps(spark, ["..s", "..."])).orderBy("episode_idx", "t").collect()
    assert [(r.next_reward, r.reward_to_go, r.terminal) for r in t] == [(1.0, 3.0, 0.0), (2.0, 3.0, 0.0), (0.0, 2.0, 1.0), (1.0, 3.0, 0.0), (2.0, 3.0, 0.0), (0.0, 2.0, 0.0)]


def test_violations(spark):
    rows = [(0, 0, 0, 1.0, False, False), (0, 0, 1, math.nan, True, False), (0, 0, 2, 1.0, False, False), (0, 1, 1, 1.0, True, True)]
    df = spark.createDataFrame(rows, "variant long, episode_idx long, t long, reward double, terminated boolean, truncated boolean")
    assert sorted((r.episode_idx, r.rule) for r in E.violations(df).collect()) == [(0, "reward not finite"), (0, "terminated before the end"), (1, "step out of order"), (1, "terminated and truncated")]


def test_constant_slots(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (0, [1.0, 5.0, 3.0]), (1, [7.0, 7.0, 7.0])], "g int, v array<double>")
    assert sorted(map(tuple, E.constant_slots(df, "v", "g").collect())) == [(0, 0, 1.0), (0, 2, 3.0), (1, 0, 7.0), (1, 1, 7.0), (1, 2, 7.0)]
