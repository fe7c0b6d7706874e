"""Queries: composite studies over rollout results and training diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import episodes as E
from stridelake.operators import metrics as M
from stridelake.operators import ordered as O
from stridelake.operators import sampling as S
from stridelake.operators import studies as T
from stridelake.plans.registry import query
from stridelake.sources.tables import RESULTS_SQL, STEPS_SQL, actions, episode_results, steps, table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("success").cast("int")
    r = episode_results(spark, sf).groupBy("family", "seed", "step")
    r = r.agg(F.round(F.avg(F.when(F.col("split") == "train", s)), 6).alias("train"), F.round(F.avg(F.when(F.col("split") == "test", s)), 6).alias("test"))
    return r.filter("train is not null and test is not null")


_REC = f"""{RESULTS_SQL}, rec AS (SELECT * FROM (SELECT family, seed, step, round(avg(CAST(success AS INTEGER)) FILTER (split = 'train'), 6) AS train, round(avg(CAST(success AS INTEGER)) FILTER (split = 'test'), 6) AS test
    FROM results GROUP BY ALL) WHERE train IS NOT NULL AND test IS NOT NULL),
    cur AS (SELECT family, step, round(avg(train), 8) AS train, round(avg(test), 8) AS test, round(avg((train + test) / 2), 8) AS joint, list(test ORDER BY seed) AS ts FROM rec GROUP BY ALL),
    peak AS (SELECT family, min(step) AS peak_step FROM (SELECT *, lag(test) OVER w AS b, lead(test, 1) OVER w AS t1, lead(test, 2) OVER w AS t2,
        max(test) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS best, last_value(train) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS te,
        last_value(ts) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tse FROM cur WINDOW w AS (PARTITION BY family ORDER BY step))
      WHERE (b IS NULL OR test >= b) AND t1 < test AND t2 < t1 AND test - t2 >= 0.02 AND best < test AND te >= train
        AND len(list_filter(list_zip(ts, tse), lambda x: x[2] < x[1])) >= 2 GROUP BY family)"""


@query(f"""WITH {_REC}, ok AS (SELECT cur.*, peak_step FROM cur LEFT JOIN peak USING (family) WHERE peak_step IS NULL OR step <= peak_step)
    SELECT family, step AS selected_step, round(train, 6) AS train, round(test, 6) AS test, peak_step FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY joint DESC, test DESC, step) AS n FROM ok) WHERE n = 1""")
def cq6_select_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """One shared checkpoint for each family before sustained overfitting (also the overfit peak window)."""
    s = T.select_checkpoint(_records(spark, sf), ["family"])
    return s.select("family", "selected_step", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"), "peak_step")


@query()
def cq6_budget_extension(spark: SparkSession, sf: str) -> DataFrame:
    b = T.budget_extension(_records(spark, sf), ["family"])
    return b.select("family", "status", F.round("train_delta", 6).alias("train_delta"), F.round("test_delta", 6).alias("test_delta"), "recommended")


@query(f"""WITH {_REC} SELECT family, peak_step FROM peak""")
def wn9_overfit_peak(spark: SparkSession, sf: str) -> DataFrame:
    return T.overfit_peaks(T.curves(_records(spark, sf), ["family"]), ["family"])


@query()
def wn10_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """The plateau rule, folded over each family's ordered curve; tested against a plain loop."""
    c = T.curves(_records(spark, sf), ["family"])
    v = c.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("step", F.round("train", 6).alias("value")))).alias("v"))
    s = T.early_stop(F.col("v"), 1993, 0.02, 2)
    return v.select("family", s["best"].alias("best"), s["best_step"].alias("best_step"), s["stop_step"].alias("stop_step"))


_MET = """SELECT family, variant, 'success' AS metric, round(avg(CAST(success AS INTEGER)), 6) AS value FROM results GROUP BY family, variant
    UNION ALL SELECT family, variant, 'length', round(avg(length), 6) FROM results GROUP BY family, variant"""


@query(f"""WITH {RESULTS_SQL}, m AS ({_MET}), stored AS (SELECT family, variant, metric, CASE WHEN length(variant) % 3 = 0 THEN value + 0.5 ELSE value END AS value FROM m WHERE length(variant) % 5 <> 0)
    SELECT family, variant, metric, CASE WHEN s.value IS NULL THEN 'not stored' ELSE 'differs' END AS finding FROM m LEFT JOIN stored s USING (family, variant, metric)
    WHERE s.value IS NULL OR abs(s.value - m.value) > 0.001""")
def cq4_rollout_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Recomputed metrics against a stored copy in which some are missing and some are off."""
    g = episode_results(spark, sf).groupBy("family", "variant").agg(F.round(M.rate(F.col("success")), 6).alias("success"), F.round(F.avg("length"), 6).alias("length"))
    m = T.unpivot(g, ["family", "variant"], ["success", "length"])
    stored = m.filter(F.length("variant") % 5 != 0).withColumn("value", F.when(F.length("variant") % 3 == 0, F.col("value") + 0.5).otherwise(F.col("value")))
    return T.audit(stored, m, ["family", "variant"], 0.001).select("family", "variant", "metric", "finding")


@query(f"""WITH {RESULTS_SQL} SELECT seed AS algorithm, step, split, count(*) AS episodes, round(avg(CAST(success AS INTEGER)), 6) AS success_rate, round(avg(length), 4) AS length FROM results GROUP BY ALL""")
def cq5_checkpoint_curve(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf).withColumnRenamed("seed", "algorithm")
    return r.groupBy("algorithm", "step", "split").agg(F.count(F.lit(1)).alias("episodes"), F.round(M.rate(F.col("success")), 6).alias("success_rate"), F.round(F.avg("length"), 4).alias("length"))


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT family, variant, seed, round(avg(CAST(success AS INTEGER)), 6) AS v FROM results GROUP BY ALL),
    p AS (SELECT a.family, a.seed, count(*) AS n, round(avg(b.v - a.v), 6) AS gain FROM r a JOIN r b ON a.family = b.family AND a.variant = b.variant AND b.seed = a.seed + 1 GROUP BY ALL)
    SELECT family, seed AS config, n, gain, gain >= 0.01 AS passes FROM p""")
def cq7_scaling_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gain of each configuration over the next smaller one, paired by variant."""
    r = episode_results(spark, sf).groupBy("family", "variant", "seed").agg(F.round(M.rate(F.col("success")), 6).alias("v"))
    b = r.select("family", "variant", (F.col("seed") - 1).alias("seed"), F.col("v").alias("w"))
    g = r.join(b, ["family", "variant", "seed"]).groupBy("family", F.col("seed").alias("config")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("w") - F.col("v")), 6).alias("gain"))
    return g.withColumn("passes", F.col("gain") >= 0.01)


@query("""WITH r AS (SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
    g AS (SELECT run, avg(CASE WHEN value - 20 > 0 THEN 1.0 ELSE 0.0 END) AS moving, min(value / 1000) FILTER (back <= 3) AS spread, max(value) FILTER (back = 1) / max(value) FILTER (epoch = 1) AS ratio FROM r GROUP BY run)
    SELECT run, CASE WHEN moving < 0.95 OR spread < 0.001 OR ratio >= 1 THEN 'unstable' ELSE 'stable' END AS verdict,
    concat_ws('; ', CASE WHEN moving < 0.95 THEN 'gradients vanish' END, CASE WHEN spread < 0.001 THEN 'actions collapse' END, CASE WHEN ratio >= 1 THEN 'loss does not fall' END) AS reasons FROM g""")
def cq8_run_stability(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), F.col("value").alias("loss"), (F.col("value") - 20).alias("gradient"), (F.col("value") / 1000).alias("spread"))
    return T.stability(e, ["run"])


@query("""SELECT s_nationkey AS family, s_suppkey AS config, s_acctbal AS cost FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey
    AND b.s_acctbal <= a.s_acctbal AND b.s_suppkey % 50 >= a.s_suppkey % 50 AND (b.s_acctbal < a.s_acctbal OR b.s_suppkey % 50 > a.s_suppkey % 50))""")
def cq9_pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("config"), F.col("s_acctbal").alias("cost"), (F.col("s_suppkey") % 50).alias("gain"))
    return O.pareto(s, ["family"], "cost", "gain").select("family", "config", "cost")


@query("""SELECT c_custkey AS run, 'segment' AS key, 'BUILDING' AS wanted, c_mktsegment AS found FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT c_custkey, 'nation', '7', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey <> 7""")
def cq10_conformance(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    actual = c.unpivot(["run"], ["segment", "nation"], "key", "value")
    wanted = c.select("run", F.lit("BUILDING").alias("segment"), F.lit("7").alias("nation")).unpivot(["run"], ["segment", "nation"], "key", "value")
    return T.conformance(wanted, actual)


@query(f"""WITH {RESULTS_SQL}, ref AS (SELECT family, avg(ret) FILTER (seed = 0) AS lo, max(ret) AS hi FROM results GROUP BY family),
    m AS (SELECT family, variant, count(*) AS n, avg(ret) AS mean FROM results WHERE seed <> 0 GROUP BY ALL)
    SELECT family, variant, n, round(100 * (mean - lo) / (hi - lo), 4) AS score FROM m JOIN ref USING (family)""")
def cq11_score_report(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf)
    ref = r.groupBy("family").agg(F.avg(F.when(F.col("seed") == 0, F.col("ret"))).alias("lo"), F.max("ret").alias("hi"))
    m = r.filter("seed <> 0").groupBy("family", "variant").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean")).join(F.broadcast(ref), "family")
    return m.select("family", "variant", "n", F.round(M.normalized_score(F.col("mean"), F.col("lo"), F.col("hi")), 4).alias("score"))


@query(f"""WITH {STEPS_SQL}, e AS (SELECT variant, episode_idx, count(*) AS n FROM steps GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY sha256('5:' || variant || ':' || episode_idx), episode_idx) AS r FROM e),
    k AS (SELECT variant, sum(n) AS sampled, sum(n * 64) AS bytes FROM s WHERE r <= 4 GROUP BY variant), t AS (SELECT variant, sum(n) AS total FROM e GROUP BY variant)
    SELECT variant, CAST(ceil(CAST(bytes * total AS DOUBLE) / sampled) AS BIGINT) AS bytes, CAST(ceil(total / 32.0) AS BIGINT) AS batches FROM t JOIN k USING (variant)""")
def cq12_size_and_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("steps"))
    sample = S.first_by_hash(e, ["variant"], "episode_idx", 5, 4).select("variant", "steps", (F.col("steps") * 64).alias("bytes"))
    est = M.size_estimate(sample, e.groupBy("variant").agg(F.sum("steps").alias("steps")), "variant")
    return est.select("variant", "bytes", F.ceil(F.col("target_steps") / 32).alias("batches"))


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT family, seed AS shard, count(*) AS n, count(*) FILTER (success) AS k, min(length) AS lo, max(length) AS hi FROM results GROUP BY ALL)
    SELECT family, count(*) AS shards, CAST(sum(n) AS BIGINT) AS episodes, round(sum(k) / sum(n), 6) AS rate, min(lo) AS length_min, max(hi) AS length_max, sum(n) >= 100 AND sum(k) / sum(n) >= 0.4 AS met FROM s GROUP BY family""")
def cq13_generation_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = episode_results(spark, sf).groupBy("family", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("k"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    return s.groupBy("family").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n").alias("episodes"), F.round(F.sum("k") / F.sum("n"), 6).alias("rate"), F.min("lo").alias("length_min"), F.max("hi").alias("length_max"), M.success_requirement(F.sum("n"), F.sum("k"), 100, 0.4).alias("met")
    )


@query(f"""WITH {RESULTS_SQL} SELECT family AS run, variant, episode_idx, success FROM results""")
def exp4_tree_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rollout records (variants to episodes) of up to 1,024 neighbouring episodes, taken apart again."""
    r = episode_results(spark, sf).withColumn("block", F.floor(F.col("episode_idx") / 1024))
    v = r.groupBy("family", "block", "variant").agg(F.struct(F.collect_list(F.struct("episode_idx", "success")).alias("episodes")).alias("v"))
    tree = v.groupBy(F.col("family").alias("run"), "block").agg(F.map_from_entries(F.collect_list(F.struct("variant", "v"))).alias("variants"))
    return T.flatten_tree(tree)


@query(f"""WITH {STEPS_SQL}, e AS (SELECT variant, episode_idx, count(*) AS n FROM steps GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY sha256(variant || ':1:' || episode_idx), episode_idx) AS r, count(*) OVER (PARTITION BY variant) AS c FROM e),
    sp AS (SELECT variant, episode_idx, CASE WHEN r <= floor(c * 0.9) THEN 'train' ELSE 'val' END AS split FROM o),
    tr AS (SELECT *, lead(reward) OVER (PARTITION BY variant, episode_idx ORDER BY t) AS nx FROM steps)
    SELECT variant, split, count(*) AS transitions, count(DISTINCT episode_idx) AS episodes, round(sum(coalesce(nx, 0)), 2) AS next_sum FROM tr JOIN sp USING (variant, episode_idx) GROUP BY ALL""")
def cq2_replay_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Split, transitions and the manifest of a replay dataset."""
    s = steps(spark, sf)
    sp = S.split(s.select("variant", "episode_idx").distinct(), ["variant"], "episode_idx", 1, 0.9)
    t = E.transitions(s).join(sp, ["variant", "episode_idx"])
    return t.groupBy("variant", "split").agg(F.count(F.lit(1)).alias("transitions"), F.countDistinct("episode_idx").alias("episodes"), F.round(F.sum("next_reward"), 2).alias("next_sum"))


@query()
def cq3_goal_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Goal-conditioned samples with standardised rewards: split, moments, goals; its parts have oracles of their own."""
    s = steps(spark, sf)
    m = s.groupBy("variant").agg(F.avg("reward").alias("m"), F.stddev_pop("reward").alias("sd"))
    g = S.relabel_goals(s, 31, 0.2, 0.5, 0.95).join(F.broadcast(m), "variant")
    z = (F.col("reward") - F.col("m")) / F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd"))
    return g.groupBy("variant", "goal_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(z), 4).alias("z"), F.round(F.avg(F.col("goal_t") - F.col("t")), 4).alias("ahead"))


@query(f"""WITH {STEPS_SQL}, p AS (SELECT *, max(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY variant, episode_idx) AS won FROM steps)
    SELECT variant, episode_idx, t, 'step ' || t || ' of ' || episode_idx AS prompt, CAST(least(greatest(round_even(reward, 0), -100), 100) AS INTEGER) AS label FROM p WHERE won = 1""")
def cq1_training_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, prompt and action label of every step: the sample build in one plan."""
    from stridelake.functions.text import render

    s = E.keep_successful(steps(spark, sf))
    prompt = render("step {t} of {episode_idx}", {"t": F.col("t"), "episode_idx": F.col("episode_idx")})
    label = F.least(F.greatest(F.rint("reward"), F.lit(-100.0)), F.lit(100.0)).cast("int")
    return s.select("variant", "episode_idx", "t", prompt.alias("prompt"), label.alias("label"))


@query()
def sm19_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of each family's paired difference from 10,000 hierarchical replicates over all of its episodes."""
    p = episode_results(spark, sf).select("family", "seed", "variant", (F.col("success").cast("double") - 0.5).alias("diff"))
    i = S.interval(S.bootstrap_groups(p, "family", 10_000, 99), by=["family"])
    return i.select("family", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")), "replicates")


@query("""SELECT label AS variant, CAST(count(*) AS BIGINT) AS n, round(avg(l), 6) AS l1 FROM (SELECT CAST(label AS BIGINT) AS label, abs((-1 + (list_position(embedding[1:16], list_max(embedding[1:16])) - 1) / 15.0::DOUBLE * 2) - (-1 + (vec_id % 16) / 15.0::DOUBLE * 2)) AS l FROM embeddings) GROUP BY label""")
def sc32_greedy_l1(spark: SparkSession, sf: str) -> DataFrame:
    from stridelake.functions.actions import greedy_l1

    a = actions(spark, sf, 16)
    return a.withColumn("l", greedy_l1(F.col("action"), F.col("episode_idx") % 16, 16)).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 6).alias("l1"))
