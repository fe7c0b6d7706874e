"""Queries: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import episodes as E
from stridelake.operators import metrics as M
from stridelake.plans.registry import query
from stridelake.sources.tables import RESULTS_SQL, STEPS_SQL, actions, episode_results, steps, table


def _r(c, n: int = 4):
    return F.round(c, n)


@query(f"""WITH {STEPS_SQL}, e AS (SELECT variant, episode_idx, count(*) AS n FROM steps GROUP BY ALL)
    SELECT variant, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS steps, least(count(*), 20) AS target FROM e GROUP BY variant""")
def ag1_variant_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("variant").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("steps"), F.least(F.count(F.lit(1)), F.lit(20)).alias("target"))


@query(f"""WITH {STEPS_SQL}, v AS (SELECT variant, count(DISTINCT episode_idx) AS n FROM steps GROUP BY variant)
    SELECT variant, n AS episodes, (SELECT min(n) FROM v) AS balanced FROM v""")
def ag2_balanced_target(spark: SparkSession, sf: str) -> DataFrame:
    v = steps(spark, sf).groupBy("variant").agg(F.countDistinct("episode_idx").alias("episodes"))
    return v.crossJoin(F.broadcast(v.agg(F.min("episodes").alias("balanced"))))


@query(f"""WITH {STEPS_SQL} SELECT variant, count(DISTINCT CASE WHEN episode_idx % 10 < 9 THEN episode_idx END) AS train_episodes,
    count(DISTINCT CASE WHEN episode_idx % 10 = 9 THEN episode_idx END) AS val_episodes,
    count(*) FILTER (episode_idx % 10 < 9) AS train_steps, count(*) FILTER (episode_idx % 10 = 9) AS val_steps FROM steps GROUP BY variant""")
def ag3_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    s, val = steps(spark, sf), F.col("episode_idx") % 10 == 9
    return s.groupBy("variant").agg(
        F.countDistinct(F.when(~val, F.col("episode_idx"))).alias("train_episodes"), F.countDistinct(F.when(val, F.col("episode_idx"))).alias("val_episodes"), F.count_if(~val).alias("train_steps"), F.count_if(val).alias("val_steps")
    )


@query("""SELECT c_nationkey AS variant, round(coalesce(avg(c_acctbal), 0), 4) AS return_mean, round(coalesce(stddev_pop(c_acctbal), 0), 4) AS return_std FROM customer GROUP BY c_nationkey""")
def ag4_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("variant")).agg(_r(M.mean_or_zero(F.col("c_acctbal"))).alias("return_mean"), _r(M.std_or_zero(F.col("c_acctbal"))).alias("return_std"))


@query("""SELECT s_nationkey AS variant, round(avg(CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END), 4) AS return_mean,
    round(avg(CASE WHEN s_acctbal >= 0 THEN s_acctbal END), 4) AS difficulty_mean, count(*) FILTER (s_acctbal < 0) AS failed FROM supplier GROUP BY s_nationkey""")
def ag5_failed_workers(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("s_acctbal") < 0
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("variant")).agg(
        _r(F.avg(F.when(failed, 0.0).otherwise(F.col("s_acctbal")))).alias("return_mean"), _r(F.avg(F.when(~failed, F.col("s_acctbal")))).alias("difficulty_mean"), F.count_if(failed).alias("failed")
    )


@query("""SELECT l_returnflag, round_even(coalesce(1000 * sum(l_tax) / nullif(sum(l_quantity), 0), 0), 2) AS ms_per_action FROM lineitem GROUP BY l_returnflag""")
def ag6_ratio_of_sums(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(M.ratio_of_sums(F.col("l_tax"), F.col("l_quantity"), 1000.0).alias("ms_per_action"))


@query("""SELECT o_custkey, CASE WHEN count(o_orderstatus) = 0 THEN NULL WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'mixed' END AS source FROM orders GROUP BY o_custkey""")
def ag7_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(M.collapse(F.col("o_orderstatus")).alias("source"))


@query("""SELECT event_type, count(*) FILTER (value > 50) AS completed, count(*) FILTER (value <= 50) AS failed, CAST(sum(event_id % 3) AS BIGINT) AS fallbacks FROM events GROUP BY event_type""")
def ag8_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("completed"), F.count_if(F.col("value") <= 50).alias("failed"), F.sum(F.col("event_id") % 3).alias("fallbacks"))


@query(f"""WITH {STEPS_SQL}, b AS (SELECT variant, episode_idx, max(t) AS last_t, min(t) FILTER (success) AS first_t FROM steps GROUP BY ALL),
    cut AS (SELECT s.* FROM steps s JOIN b USING (variant, episode_idx) WHERE t <= least(last_t, coalesce(first_t + 2, last_t))),
    e AS (SELECT variant, episode_idx, bool_or(success) AS success, CAST(min(t) FILTER (success) AS DOUBLE) AS first_success, sum(reward) AS ret, count(*) AS length FROM cut GROUP BY ALL)
    SELECT variant, count(*) AS episodes, count(*) FILTER (success) AS successes, round(avg(CAST(success AS INTEGER)), 6) AS success_rate,
    round(avg(first_success), 6) AS first_success_mean, round(stddev_pop(first_success), 6) AS first_success_std, round(avg(ret), 4) AS return_mean,
    round(stddev_pop(ret), 4) AS return_std, round(avg(length), 6) AS length_mean FROM e GROUP BY variant""")
def ag9_rollout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rollout metrics of episodes cut two steps after their first success."""
    cut = E.truncate_at_event(steps(spark, sf), F.col("success"), 2)
    ep = cut.groupBy("variant", "episode_idx").agg(F.bool_or("success").alias("success"), F.min(F.when(F.col("success"), F.col("t"))).cast("double").alias("first_success"), F.sum("reward").alias("ret"), F.count(F.lit(1)).alias("length"))
    m = M.rollout_metrics(ep, ["variant"])
    digits = {"return_mean": 4, "return_std": 4}
    return m.select("variant", "episodes", "successes", *(F.round(c, digits.get(c, 6)).alias(c) for c in m.columns[3:]))


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT coalesce(variant, 'ALL') AS variant, count(*) AS n, count(*) FILTER (success) AS k, round(avg(length), 4) AS length FROM results GROUP BY ROLLUP(variant))
    SELECT * FROM r""")
def ag10_grand_total(spark: SparkSession, sf: str) -> DataFrame:
    return M.with_total(episode_results(spark, sf), "variant", lambda g: g.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("k"), _r(F.avg("length")).alias("length")))


@query(f"""WITH {RESULTS_SQL} SELECT split, step, round(avg(CAST(success AS INTEGER)), 6) AS success_rate, round(avg(ret), 2) AS ret FROM results GROUP BY ALL""")
def ag11_split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return episode_results(spark, sf).groupBy("split", "step").agg(_r(M.rate(F.col("success")), 6).alias("success_rate"), _r(F.avg("ret"), 2).alias("ret"))


_MACRO = """u AS (SELECT family, split, step, variant, count(*) AS n, count(*) FILTER (success) AS k FROM results GROUP BY ALL)"""


@query(f"""WITH {RESULTS_SQL}, {_MACRO} SELECT family, split, step, round(avg(k / n), 6) AS macro, round(sum(k) / sum(n), 6) AS micro, CAST(sum(n) AS BIGINT) AS episodes FROM u GROUP BY ALL""")
def ag12_macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    m = M.macro_micro(episode_results(spark, sf), ["family", "split", "step"], "variant")
    return m.select("family", "split", "step", _r(F.col("macro"), 6).alias("macro"), _r(F.col("micro"), 6).alias("micro"), "episodes")


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT family, step, seed, round(avg(CAST(success AS INTEGER)), 4) AS v FROM results GROUP BY ALL)
    SELECT family, step, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, string_agg(printf('%.4f', v), ',' ORDER BY seed) AS vals FROM s GROUP BY ALL""")
def ag13_seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = episode_results(spark, sf).groupBy("family", "step", "seed").agg(_r(M.rate(F.col("success"))).alias("v"))
    s = M.seed_summary(v, ["family", "step"], "v")
    return s.select("family", "step", _r(F.col("mean"), 6).alias("mean"), _r(F.col("std"), 6).alias("std"), F.array_join(F.transform("values", lambda x: F.format_string("%.4f", x)), ",").alias("vals"))


_REF = """ref AS (SELECT family, min(ret) AS lo, max(ret) AS hi FROM results GROUP BY family)"""


@query(f"""WITH {RESULTS_SQL}, {_REF}, m AS (SELECT family, variant, avg(ret) AS mean, stddev_pop(ret) AS std FROM results GROUP BY ALL)
    SELECT family, variant, round(100 * (mean - lo) / (hi - lo), 4) AS score, round(100 * std / abs(hi - lo), 4) AS score_std FROM m JOIN ref USING (family)""")
def ag14_normalized_score(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf)
    ref = r.groupBy("family").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    m = r.groupBy("family", "variant").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std")).join(F.broadcast(ref), "family")
    lo, hi = F.col("lo"), F.col("hi")
    return m.select("family", "variant", _r(M.normalized_score(F.col("mean"), lo, hi)).alias("score"), _r(M.normalized_std(F.col("std"), lo, hi)).alias("score_std"))


@query(f"""WITH {RESULTS_SQL}, {_REF}, m AS (SELECT family, variant, avg(ret) AS mean FROM results GROUP BY ALL)
    SELECT family, round(avg(100 * (mean - lo) / (hi - lo)), 4) AS score FROM m JOIN ref USING (family) GROUP BY family""")
def ag15_mean_score(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf)
    ref = r.groupBy("family").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    m = r.groupBy("family", "variant").agg(F.avg("ret").alias("mean")).join(F.broadcast(ref), "family")
    return m.groupBy("family").agg(_r(F.avg(M.normalized_score(F.col("mean"), F.col("lo"), F.col("hi")))).alias("score"))


@query(f"""WITH {RESULTS_SQL} SELECT family, round(avg(ret) FILTER (seed = 0), 2) AS random, round(avg(ret) FILTER (seed = 1), 2) AS expert FROM results GROUP BY family""")
def ag16_reference_scores(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf).withColumn("policy", F.when(F.col("seed") == 0, "random").when(F.col("seed") == 1, "expert"))
    return r.groupBy("family").pivot("policy", ["random", "expert"]).agg(_r(F.avg("ret"), 2))


@query("""SELECT p_brand, min(p_size) AS size_min, max(p_size) AS size_max, round(avg(p_size), 4) AS size_mean FROM part GROUP BY p_brand""")
def ag17_triplet(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").groupBy("p_brand").agg(*M.triplet(F.col("p_size"), "size"))
    return t.withColumn("size_mean", _r(F.col("size_mean")))


@query(f"""WITH {RESULTS_SQL}, s AS (SELECT family, seed, count(*) AS episodes, count(*) FILTER (success) AS wins FROM results GROUP BY ALL)
    SELECT family, seed AS shard, episodes, wins, CAST(coalesce(sum(episodes) OVER (PARTITION BY family ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_episode,
    round(CAST(wins AS DOUBLE) / episodes, 6) AS rate FROM s""")
def ag18_generation_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = episode_results(spark, sf).groupBy("family", F.col("seed").alias("shard")).agg(F.count(F.lit(1)).alias("episodes"), F.count_if("success").alias("wins"))
    before = Window.partitionBy("family").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("first_episode", F.coalesce(F.sum("episodes").over(before), F.lit(0).cast("long"))).withColumn("rate", _r(F.coalesce(F.try_divide("wins", "episodes"), F.lit(0.0)), 6))


@query("""WITH l AS (SELECT CAST(label AS BIGINT) AS variant, unnest(range(8)) AS dim, unnest(embedding[1:8]) AS v FROM embeddings),
    m AS (SELECT variant, dim, count(*) AS n, sum(CAST(v AS DOUBLE)) AS s, sum(CAST(v AS DOUBLE) * v) AS q FROM l GROUP BY ALL)
    SELECT variant, CAST(dim AS INTEGER) AS dim, n, round(s / n, 6) AS mean, round(CASE WHEN sqrt(greatest(q / n - (s / n) * (s / n), 0)) < 1e-6 THEN 1 ELSE sqrt(greatest(q / n - (s / n) * (s / n), 0)) END, 6) AS std FROM m""")
def ag19_state_moments(spark: SparkSession, sf: str) -> DataFrame:
    m = M.moments(actions(spark, sf), "action", ["variant"])
    return m.withColumn("mean", _r(F.col("mean"), 6)).withColumn("std", _r(F.col("std"), 6))


@query("""SELECT v AS size, CAST(count(p_partkey) AS BIGINT) AS n FROM range(0, 61) r(v) LEFT JOIN part ON p_size = v GROUP BY v""")
def ag20_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("size"))
    return M.histogram(p, "size", spark.range(61).select(F.col("id").alias("size")))


@query("""WITH l AS (SELECT unnest(range(8)) AS dim, CAST(unnest(embedding[1:8]) AS DOUBLE) AS v FROM embeddings)
    SELECT CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(abs(v)), 6) AS abs_mean FROM l GROUP BY dim""")
def ag21_action_probe(spark: SparkSession, sf: str) -> DataFrame:
    long = actions(spark, sf).select(F.posexplode("action").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    v = F.col("v")
    return long.groupBy("dim").agg(_r(F.avg(v), 6).alias("mean"), _r(F.stddev_pop(v), 6).alias("std"), _r(F.min(v), 6).alias("lo"), _r(F.max(v), 6).alias("hi"), _r(F.avg(F.abs(v)), 6).alias("abs_mean"))


@query("""SELECT user_id % 7 AS run, round(max(value), 4) AS peak, arg_max(event_type, event_id) AS last_kind, round(count(*) / nullif(sum(value), 0), 6) AS per_second FROM events GROUP BY 1""")
def ag22_resources(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("run", F.col("user_id") % 7)
    return e.groupBy("run").agg(_r(F.max("value")).alias("peak"), M.last_by("event_type", "event_id").alias("last_kind"), _r(F.try_divide(F.count(F.lit(1)), F.sum("value")), 6).alias("per_second"))


@query("""WITH s AS (SELECT source, sum(n_chars) AS sampled_steps, sum(n_chars * 3) AS sampled_bytes FROM documents WHERE doc_id % 7 = 0 GROUP BY source),
    t AS (SELECT source, sum(n_chars) AS target_steps FROM documents GROUP BY source)
    SELECT source, CAST(target_steps AS BIGINT) AS target_steps, CAST(sampled_steps AS BIGINT) AS sampled_steps, CAST(ceil(CAST(sampled_bytes * target_steps AS DOUBLE) / sampled_steps) AS BIGINT) AS bytes FROM t JOIN s USING (source)""")
def ag23_size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    sample = d.filter("doc_id % 7 = 0").select("source", F.col("n_chars").alias("steps"), (F.col("n_chars") * 3).alias("bytes"))
    est = M.size_estimate(sample, d.groupBy("source").agg(F.sum("n_chars").alias("steps")), "source")
    return est.select("source", "target_steps", "sampled_steps", "bytes")


@query("""WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS part, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS samples FROM nation),
    r AS (SELECT part // 4 AS round, CAST(max(CAST(ceil(samples / 32.0) AS BIGINT)) AS BIGINT) AS batches, CAST(sum(samples) AS BIGINT) AS samples, count(*) AS parts FROM p GROUP BY 1)
    SELECT *, batches * 32 * parts - samples AS padding FROM r""")
def ag24_round_batches(spark: SparkSession, sf: str) -> DataFrame:
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    parts = n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy(F.col("n_nationkey").cast("long").alias("part")).agg(F.count("c_custkey").alias("samples"))
    return M.round_batches(parts, 4, 32)


@query("""SELECT event_type, part, round(avg(v), 6) AS mean, count(*) AS batches FROM (
    SELECT event_type, 'loss' AS part, value AS v FROM events UNION ALL SELECT event_type, 'stop', value / 2 FROM events) GROUP BY ALL""")
def ag25_loss_parts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.create_map(F.lit("loss"), F.col("value"), F.lit("stop"), F.col("value") / 2).alias("parts"))
    return M.mean_parts(e, ["event_type"], "parts").withColumn("mean", _r(F.col("mean"), 6))


@query("""SELECT CAST(event_id % 4 AS BIGINT) AS rank, count(*) AS n, round(sum(value), 4) AS s, round((SELECT avg(value) FROM events), 6) AS reduced FROM events GROUP BY 1""")
def ag26_reduce_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks' partial sums and the mean over all: Spark's partial and final aggregation."""
    e = table(spark, sf, "events")
    part = e.groupBy((F.col("event_id") % 4).alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    whole = part.agg(_r(F.sum("s") / F.sum("n"), 6).alias("reduced"))
    return part.withColumn("s", _r(F.col("s"))).crossJoin(F.broadcast(whole))


@query("""SELECT s_nationkey % 5 AS run, round(min(abs(s_acctbal)), 4) AS least, round(median(d), 4) AS median, round(avg(d), 4) AS mean FROM (
    SELECT s_nationkey, s_acctbal, abs(s_acctbal) AS d FROM supplier) GROUP BY 1""")
def ag28_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("run", F.col("s_nationkey") % 5)
    d = M.distance_stats(s, ["run", "s_suppkey"], ["run"], F.abs("s_acctbal"))
    return d.select("run", *(_r(F.col(c)).alias(c) for c in ("least", "median", "mean")))


@query("""SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1""")
def ag29_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""WITH w AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back, first_value(value) OVER (PARTITION BY user_id ORDER BY ts) AS first FROM events)
    SELECT user_id AS run, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(min(value) FILTER (back <= 3), 4) AS tail_min,
    round(max(value) FILTER (back = 1) / max(first), 6) AS decrease FROM w GROUP BY user_id""")
def ag30_range_figures(spark: SparkSession, sf: str) -> DataFrame:
    from stridelake.operators.studies import run_figures

    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("step"), "value")
    f = run_figures(e, ["run"], "step", "value", 50.0)
    near = lambda c, d: F.round(F.col(c) * 10.0**d) / 10.0**d  # noqa: E731  # rounded as DuckDB does: scaled as a double, not as its decimal text
    return f.select("run", *(near(c, d).alias(c) for c, d in (("positive", 6), ("tail_min", 4), ("decrease", 6))))


@query("""SELECT c_mktsegment, count(DISTINCT (o_orderpriority, o_orderstatus)) AS pairs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def ag31_pair_diversity(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.countDistinct("o_orderpriority", "o_orderstatus").alias("pairs"))


@query("""SELECT c_nationkey AS variant, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal = 0) AS zero FROM customer GROUP BY 1""")
def ag32_signs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("variant")).agg(*M.signs(F.col("c_acctbal")))


@query("""SELECT o_orderpriority AS probe, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS reached, round(avg(CAST(o_totalprice < 100000 AS INTEGER)), 6) AS shortest, count(*) AS n FROM orders GROUP BY 1""")
def ag27_probe_rates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("probe")).agg(_r(M.rate(F.col("o_orderstatus") == "F"), 6).alias("reached"), _r(M.rate(F.col("o_totalprice") < 100000), 6).alias("shortest"), F.count(F.lit(1)).alias("n"))
