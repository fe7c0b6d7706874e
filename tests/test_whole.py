"""Queries take every row of their tables: counted on small tables of their own."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import corpus as C
from stridelake.operators import sampling as S
from stridelake.plans.catalog import QUERIES
from stridelake.sources.tables import episode_results, table


def events(spark, folder, rows):
    """An event table of (user_id, event_type), one a second in the order given."""
    start = datetime(2024, 1, 1)
    data = [(i + 1, start + timedelta(seconds=i), u, kind, float(i)) for i, (u, kind) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_every_segment_of_a_long_episode(spark, tmp_path):
    sizes = {1: 1, 2: 20, 3: 21, 4: 60, 5: 61, 6: 1001}
    d = events(spark, tmp_path, [(u, "view") for u, n in sizes.items() for _ in range(n)])
    got = sorted((r.episode_idx, r.part, r.n) for r in QUERIES["exp3_segment_payloads"](spark, d).collect())
    assert got == [(u, k, n) for u, n in sizes.items() for k in range(-(-n // 20))]


def test_bootstrap_draws_from_every_episode_of_every_group(spark):
    """Against a twin that draws episodes one by one, with a cell missing and cells of unequal sizes."""
    rng = np.random.default_rng(5)
    cells = {(s, v): rng.integers(0, 2, 5 + 40 * s + (25 if v == "b" else 0)) - 0.5 for s in range(3) for v in "abc" if (s, v) != (2, "c")}
    cells[1, "a"][10:] = 0.5  # episodes behind the tenth differ from those before
    rows = [("g", s, v, float(d)) for (s, v), x in cells.items() for d in x] + [("h", 0, "a", 1.0)] * 3 + [("h", 0, "a", None)]
    df = spark.createDataFrame(rows, "family string, seed long, variant string, diff double")
    reps = S.bootstrap_groups(df, "family", 10_000, 7)
    got = {r.family: r for r in S.interval(reps, by=["family"]).collect()}
    assert {k: r.replicates for k, r in got.items()} == {"g": 10_000, "h": 10_000}
    assert (got["h"].mean, got["h"].low, got["h"].high) == (1.0, 1.0, 1.0)
    twin = []
    while len(twin) < 10_000:
        s, v = rng.integers(3, size=3), rng.choice(list("abc"), 3)
        if drawn := [rng.choice(x, len(x)) for i in s for j in v if (x := cells.get((i, j))) is not None]:
            twin.append(np.concatenate(drawn).mean())
    low, high = np.quantile(twin, [0.025, 0.975])
    assert abs(got["g"].mean - np.mean(twin)) < 0.01 and abs(got["g"].low - low) < 0.02 and abs(got["g"].high - high) < 0.02
    again = S.bootstrap_groups(df.repartition(5), "family", 10_000, 7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, reps.collect()))


def test_bootstrap_covers_all_families(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["sm19_bootstrap"](spark, d).collect()
    whole = {r.family: r.m for r in episode_results(spark, d).groupBy("family").agg(F.avg(F.col("success").cast("double") - 0.5).alias("m")).collect()}
    assert sorted(r.family for r in got) == sorted(whole) and len(whole) == 5
    assert all(r.replicates == 10_000 and r.low < whole[r.family] < r.high and abs(r.mean - whole[r.family]) < 0.01 for r in got)


def test_every_episode_of_a_tree_and_of_the_scores(spark):
    d = "/root/testdata/sf0.01"
    r = episode_results(spark, d)
    want = sorted((x.family, x.variant, x.episode_idx, x.success) for x in r.collect())
    assert len(want) == 15_000
    tree = QUERIES["exp4_tree_episodes"](spark, d)
    assert sorted((x.run, x.variant, x.episode_idx, x.success) for x in tree.collect()) == want
    scores = QUERIES["flt15_score_fields"](spark, d)
    assert sorted(scores.columns) == ["episode_idx", "ret", "variant"]
    assert sorted((x.episode_idx, x.variant, x.ret) for x in scores.collect()) == sorted((x.episode_idx, x.variant, x.ret) for x in r.collect())


def test_kinds_and_prompts_of_every_event(spark, tmp_path):
    d = events(spark, tmp_path, [(u, kind) for kind in ("view", "click", "view", "error") for u in (1, 2, 3, 5)])
    assert sorted(map(tuple, QUERIES["st7_ordered_dedupe"](spark, d).select("user_id", "kinds").collect())) == [(u, "view,click,error") for u in (1, 2, 3, 5)]
    got = sorted((r.variant, r.episode_idx, r.t, r.template, r["sample"]) for r in QUERIES["exp1_step_templates"](spark, d).collect())
    assert got == sorted((u % 5, u, t, name, 3 * t + i) for u in (1, 2, 3, 5) for t in range(4) for i, name in enumerate(("plain", "map", "sensing")))


def test_a_whole_table_is_appended_and_ranked_by_range(spark):
    d = "/root/testdata/sf0.01"
    start = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    got = QUERIES["snk2_guarded_append"](spark, d)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    keys = sorted(r.o_orderkey for r in table(spark, d, "orders").select("o_orderkey").collect())
    assert sorted((r.episode_index, r.o_orderkey) for r in got.collect()) == [(start + 1 + i, k) for i, k in enumerate(keys)]


@pytest.mark.parametrize("rows,ranges", [(1, 256), (7, 256), (40, 8), (10**6, 256)])
def test_ranges_keep_the_order(spark, monkeypatch, rows, ranges):
    monkeypatch.setattr(C, "RANGE_ROWS", rows)
    monkeypatch.setattr(C, "RANGES", ranges)
    data = [(i, None if i % 9 == 0 else f"s{i * 37 % 11}", float(i * 53 % 101)) for i in range(300)]
    new = spark.createDataFrame(data, "k long, a string, b double").repartition(5)
    old = spark.createDataFrame([], "i long, k long")
    got = C.append_rows(old, new, ["k"], "i", ["a", "b", "k"]).collect()
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[2], r[0]))
    assert [r.k for r in sorted(got, key=lambda r: r.i)] == [k for k, _, _ in want] and sorted(r.i for r in got) == list(range(300))
    assert C.append_rows(old, new.filter("k < 0"), ["k"], "i", ["k"]).collect() == []
