import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stridelake.operators import metrics as M
from stridelake.operators import studies as T
from stridelake.plans.catalog import ORACLE, QUERIES


def records(spark, curves):
    """{family: [(train, test) by step]}, or with a list of three tests for the seeds."""
    rows = [(f, s, 10 * (i + 1), float(tr), float(te[s] if isinstance(te, list) else te)) for f, c in curves.items() for i, (tr, te) in enumerate(c) for s in range(3)]
    return spark.createDataFrame(rows, "family string, seed int, step int, train double, test double")


def test_checkpoint_before_a_lasting_decline(spark):
    curves = {
        "falls": [(0.5, 0.5), (0.6, 0.6), (0.9, 0.55), (0.95, 0.5)],
        "recovers": [(0.5, 0.5), (0.6, 0.6), (0.9, 0.55), (0.95, 0.5), (0.95, 0.61)],
        "small": [(0.5, 0.6), (0.6, 0.595), (0.7, 0.59)],
        "train_too": [(0.9, 0.6), (0.8, 0.5), (0.7, 0.4)],
        "one_seed": [(0.5, [0.9, 0.5, 0.5]), (0.6, [0.5, 0.5, 0.5]), (0.7, [0.4, 0.5, 0.5])],
        "ties": [(0.5, 0.5), (0.4, 0.6), (0.5, 0.5)],
    }
    got = {r.family: (r.selected_step, r.peak_step) for r in T.select_checkpoint(records(spark, curves), ["family"]).collect()}
    assert got["falls"] == (20, 20)
    assert got["recovers"] == (50, None)
    assert got["small"] == (30, None)
    assert got["train_too"] == (10, None)
    assert got["one_seed"][1] is None
    assert got["ties"] == (20, None)


def test_longer_budgets(spark):
    curves = {"gains": [(0.1, 0.1), (0.2, 0.2), (0.3, 0.3)], "flat": [(0.3, 0.3)] * 3, "short": [(0.1, 0.1), (0.9, 0.9)], "train": [(0.1, 0.3), (0.2, 0.3), (0.3, 0.295)], "falls": [(0.1, 0.5), (0.2, 0.4), (0.3, 0.3)]}
    got = {r.family: (r.status, r.recommended) for r in T.budget_extension(records(spark, curves), ["family"]).collect()}
    assert got == {"gains": ("complete", True), "flat": ("complete", False), "short": ("insufficient", False), "train": ("complete", True), "falls": ("complete", False)}


def plateau(values, least, delta, patience):
    best = at = stop = None
    stale = 0
    for step, v in values:
        if step < least:
            continue
        if best is None or v >= best + delta:
            best, at, stale = v, step, 0
        else:
            stale += 1
            if stale >= patience:
                return best, at, step
    return best, at, stop


@pytest.mark.parametrize("vals", [[], [0.1], [0.1, 0.2, 0.2, 0.2, 0.9], [0.5, 0.4, 0.3], [0.1, 0.105, 0.11, 0.3]])
def test_plateaus(spark, vals):
    rows = [(i, float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame([(rows,)], "v array<struct<step:long,value:double>>")
    for least, delta, patience in ((0, 0.01, 2), (1, 0.0, 1), (2, 0.05, 3)):
        s = df.select(T.early_stop(F.col("v"), least, delta, patience).alias("s")).first().s
        assert (s.best, s.best_step, s.stop_step) == plateau(rows, least, delta, patience)


def test_audits(spark):
    sch = "k int, metric string, value double"
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (1, "z", math.nan), (2, "x", 5.0), (3, "x", None)], sch)
    b = spark.createDataFrame([(1, "x", 1.0005), (1, "y", 2.5), (1, "z", 1.0), (3, "x", None), (4, "x", 1.0)], sch)
    assert {(r.k, r.metric): r.finding for r in T.audit(a, b, ["k"], 0.001).collect()} == {(1, "y"): "differs", (1, "z"): "not finite", (2, "x"): "not computed", (4, "x"): "not stored"}
    e = spark.createDataFrame([(1, "lr", "1"), (1, "seed", None)], "run int, key string, value string")
    f = spark.createDataFrame([(1, "lr", "2"), (1, "seed", None), (1, "new", "3")], "run int, key string, value string")
    assert sorted((r.key, r.wanted, r.found) for r in T.conformance(e, f).collect()) == [("lr", "1", "2"), ("new", None, "3")]


def test_stability(spark):
    fine = [("ok", e, 1.0 / e, 1.0, 0.5) for e in range(1, 6)]
    bad = [("nan", 1, math.nan, 1.0, 0.5), ("nan", 2, 0.5, 1.0, 0.5), ("gap", 1, 1.0, 1.0, 0.5), ("gap", 3, 0.5, 1.0, 0.5), ("flat", 1, 1.0, 0.0, 0.5), ("flat", 2, 1.0, 1.0, 1e-5)]
    got = {r.run: (r.verdict, r.reasons) for r in T.stability(spark.createDataFrame(fine + bad, "run string, epoch int, loss double, gradient double, spread double"), ["run"]).collect()}
    assert got["ok"] == ("stable", "") and got["nan"][0] == "invalid" and got["gap"] == ("invalid", "epochs not consecutive")
    assert got["flat"] == ("unstable", "gradients vanish; actions collapse; loss does not fall")


def test_missing_components_and_empty_groups(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (None,)], "v double")
    none = F.when(F.col("v") > 9, F.col("v"))
    r = df.agg(F.avg("v"), M.mean_or_zero(none), M.std_or_zero(none), M.seed_std(F.when(F.col("v") > 0.5, F.col("v")))).first()
    assert list(r) == [0.5, 0.0, 0.0, 0.0]


def test_scores(spark):
    r = spark.range(1).select(M.normalized_score(F.lit(50.0), F.lit(0.0), F.lit(200.0)), M.normalized_std(F.lit(5.0), F.lit(200.0), F.lit(0.0))).first()
    assert list(r) == [25.0, 2.5]
    with pytest.raises(Exception, match="reference scores are equal"):
        spark.range(1).select(M.normalized_score(F.lit(50.0), F.lit(1.0), F.lit(1.0))).collect()


def test_rounds_and_budgets(spark):
    parts = spark.createDataFrame([(0, 5), (1, 9), (2, 4)], "part long, samples long")
    assert sorted((r.round, r.batches, r.padding) for r in M.round_batches(parts, 2, 4).collect()) == [(0, 3, 10), (1, 1, 0)]
    assert (M.attempt_budget(10, 0.3), M.attempt_budget(10, 0.0), M.attempt_budget(10, 0.5, 15)) == (34, 10, 15)
    with pytest.raises(ValueError):
        M.attempt_budget(10, 0.5, 9)


def test_moments_of_constant_dimensions(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "v array<double>")
    assert sorted((r.dim, r.mean, r.std) for r in M.moments(df, "v").collect()) == [(0, 1.0, 1.0), (1, 3.0, 1.0)]


def test_report(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").orderBy("a")
    assert T.markdown(df, ["a", "b"]) == "| a | b |\n|---|---|\n| 1 |  |\n| 2 | x |"
    with pytest.raises(ValueError):
        T.markdown(df, ["a"], 1)


def by_sql(spark, folder, name, events):
    """Rows of a query on events (run, seconds, value), and those of its SQL."""
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(seconds=t), u, "view", v) for i, (u, t, v) in enumerate(events)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    df, con = QUERIES[name](spark, str(folder)), duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({ORACLE[name]})").fetchall()
    return sorted(map(repr, df.collect())), sorted(repr(Row(*df.columns)(*r)) for r in want)


#: Runs that start at zero, end there, do both, or have a quotient within a rounding error of a half.
EDGES = [(1, 0, 0.0), (1, 1, 90.0), (2, 0, 30.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 0.0), (4, 0, 0.0), (4, 1, -5.0), (5, 0, 32.0), (5, 1, 65.21), (6, 0, 64.0), (6, 1, 256.9), (7, 0, 40.0)]


def test_range_figures_over_zero_and_at_halves_equal_sql(spark, tmp_path):
    got, want = by_sql(spark, tmp_path, "ag30_range_figures", EDGES)
    assert got == want and "decrease=inf" in got[0] and "decrease=nan" in got[2] and "decrease=2.037812" in got[4]


def test_stability_of_runs_that_start_at_zero_equals_sql(spark, tmp_path):
    got, want = by_sql(spark, tmp_path, "cq8_run_stability", EDGES)
    assert got == want and sum("loss does not fall" in r for r in got) == 5
