"""Queries: window functions, ordered computations and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.operators import episodes as E
from stridelake.operators import metrics as M
from stridelake.operators import ordered as O
from stridelake.plans.registry import query
from stridelake.sources.tables import RESULTS_SQL, STEPS_SQL, actions, episode_results, steps, table


@query(f"""WITH {STEPS_SQL}, h AS (SELECT *, lag(reward, 1) OVER w AS a, lag(reward, 3) OVER w AS b, lag(reward, 5) OVER w AS c FROM steps WINDOW w AS (PARTITION BY variant, episode_idx ORDER BY t))
    SELECT variant, episode_idx, t, concat_ws(';', '5:' || printf('%.2f', c), '3:' || printf('%.2f', b), '1:' || printf('%.2f', a)) AS past FROM h""")
def wn1_strided_history(spark: SparkSession, sf: str) -> DataFrame:
    s = steps(spark, sf).withColumn("h", E.history(F.col("reward"), 3, 2))
    text = F.transform("h", lambda p: F.concat(p["steps_ago"].cast("string"), F.lit(":"), F.format_string("%.2f", p["value"])))
    return s.select("variant", "episode_idx", "t", F.array_join(text, ";").alias("past"))


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, t, round(coalesce(lead(reward) OVER w, 0), 4) AS next_reward,
    round(sum(reward) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 3) AS reward_to_go, lead(t) OVER w IS NULL AS is_last,
    CASE WHEN lead(t) OVER w IS NULL AND success THEN 1.0 ELSE 0.0 END::DOUBLE AS terminal FROM steps WINDOW w AS (PARTITION BY variant, episode_idx ORDER BY t)""")
def wn2_transitions(spark: SparkSession, sf: str) -> DataFrame:
    s = E.transitions(steps(spark, sf))
    return s.select("variant", "episode_idx", "t", F.round("next_reward", 4).alias("next_reward"), F.round("reward_to_go", 3).alias("reward_to_go"), "is_last", "terminal")


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, min(t) FILTER (success) AS first_t, count(*) AS n_steps FROM steps GROUP BY ALL""")
def wn4_first_event(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_event(steps(spark, sf), F.col("success"))


@query("""SELECT p_partkey, round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY p_brand) - 1, 1), 8) AS rank_score,
    round(1 + 2.0 * ((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY p_brand) - 1, 1)), 8) AS sample_weight FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def wn5_rank_weights(spark: SparkSession, sf: str) -> DataFrame:
    r = O.rank_weights(table(spark, sf, "part"), ["p_brand"], ["p_size", "p_partkey"], 2.0)
    return r.select("p_partkey", F.round("rank_score", 8).alias("rank_score"), F.round("sample_weight", 8).alias("sample_weight"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3""")
def wn6_tail(spark: SparkSession, sf: str) -> DataFrame:
    return M.tail(table(spark, sf, "events"), ["user_id"], "event_id", 3).select("user_id", "event_id")


@query(f"""WITH {STEPS_SQL}, e AS (SELECT variant, episode_idx, count(*) AS n FROM steps GROUP BY ALL)
    SELECT variant, episode_idx, n, CAST(sum(n) OVER (PARTITION BY variant ORDER BY sha256(variant || ':' || episode_idx), episode_idx) - n AS BIGINT) AS first_step FROM e""")
def wn7_step_offsets(spark: SparkSession, sf: str) -> DataFrame:
    e = steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("variant").orderBy(F.sha2(F.concat_ws(":", F.col("variant").cast("string"), F.col("episode_idx").cast("string")), 256), "episode_idx")
    return e.withColumn("first_step", F.sum("n").over(w) - F.col("n"))


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT family, step, round(avg(CAST(success AS INTEGER)), 6) AS v FROM results GROUP BY ALL),
    d AS (SELECT family, step, round(v - lag(v) OVER w, 6) AS gain FROM r WINDOW w AS (PARTITION BY family ORDER BY step))
    SELECT family, step, gain, coalesce(gain < 0.01 AND lag(gain) OVER (PARTITION BY family ORDER BY step) < 0.01, false) AS stop FROM d""")
def wn8_two_small_gains(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf).groupBy("family", "step").agg(F.round(F.avg(F.col("success").cast("int")), 6).alias("v"))
    w = Window.partitionBy("family").orderBy("step")
    d = r.select("family", "step", F.round(F.col("v") - F.lag("v").over(w), 6).alias("gain"))
    return d.withColumn("stop", F.coalesce((F.col("gain") < 0.01) & (F.lag("gain").over(w) < 0.01), F.lit(False)))


@query("""SELECT conv_id, count(*) AS n, bool_and(turn = rn) AS consecutive FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations) GROUP BY conv_id""")
def wn13_sequence_check(spark: SparkSession, sf: str) -> DataFrame:
    """Turns are unique, so they count up from 0 exactly if the least is 0 and the largest n - 1."""
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), ((F.min("turn") == 0) & (F.max("turn") == F.count(F.lit(1)) - 1)).alias("consecutive"))


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    w AS (SELECT DISTINCT label, n, CAST(floor(s * (n - 1) / greatest(least(n, 7) - 1, 1)) AS BIGINT) AS i FROM (SELECT DISTINCT label, n FROM r), range(7) g(s) WHERE s < n)
    SELECT r.vec_id, CAST(r.label AS BIGINT) AS variant FROM r JOIN w ON r.label = w.label AND r.i = w.i""")
def wn14_linspace(spark: SparkSession, sf: str) -> DataFrame:
    return O.linspace(actions(spark, sf).select("variant", F.col("episode_idx").alias("vec_id")), ["variant"], ["vec_id"], 7).select("vec_id", "variant")


@query("""SELECT s AS step, round(CASE WHEN s < 100 THEN (s + 1) / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (s - 100) / 900.0)))) END, 8) AS scale FROM range(1000) r(s)""")
def wn15_lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), F.round(O.lr_scale(F.col("id"), 1000, 100, 900, "cosine", 0.1), 8).alias("scale"))


@query("""SELECT s AS batches, CAST(s // 4 + CASE WHEN s >= 50 AND s % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS optimizer_steps, s > 0 AND s % 10 = 0 AS due FROM range(51) r(s)""")
def wn16_step_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("id")
    return spark.range(51).select(s.alias("batches"), O.optimizer_steps(s, 4, 50).alias("optimizer_steps"), O.eval_due(s, 10).alias("due"))


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_type, p_name, p_partkey) AS pos FROM part""")
def tk1_total_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_retailprice", "p_type", "p_name", "p_partkey")
    return table(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("pos"))


@query("""SELECT p_brand, round(avg(p_retailprice), 4) AS difficulty, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part) WHERE r <= greatest(1, ceil(0.1 * c)) GROUP BY p_brand""")
def tk3_top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    top = O.top_fraction(table(spark, sf, "part"), ["p_brand"], ["p_retailprice", "p_partkey"], 0.1)
    return top.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("difficulty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, p_partkey, round((r - 1) / greatest(c - 1, 1), 8) AS rank_score FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS back FROM part WHERE p_size <= 30) WHERE back <= 5)""")
def tk5_filter_then_top(spark: SparkSession, sf: str) -> DataFrame:
    """The length filter comes before the top n, and ranks are given to what is left."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), F.desc("p_partkey"))
    top = table(spark, sf, "part").filter("p_size <= 30").withColumn("back", F.row_number().over(w)).filter("back <= 5")
    return O.rank_weights(top, ["p_brand"], ["p_retailprice", "p_partkey"], 1.0).select("p_brand", "p_partkey", F.round("rank_score", 8).alias("rank_score"))


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT family, step, round(avg(CAST(success AS INTEGER)) FILTER (split = 'train'), 6) AS train, round(avg(CAST(success AS INTEGER)) FILTER (split = 'test'), 6) AS test FROM results GROUP BY ALL)
    SELECT family, step, train, test FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round((train + test) / 2, 8) DESC, test DESC, step) AS n FROM r WHERE train IS NOT NULL AND test IS NOT NULL) WHERE n = 1""")
def tk6_arg_max(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("success").cast("int")
    r = episode_results(spark, sf).groupBy("family", "step").agg(F.round(F.avg(F.when(F.col("split") == "train", s)), 6).alias("train"), F.round(F.avg(F.when(F.col("split") == "test", s)), 6).alias("test"))
    r = r.filter("train is not null and test is not null")
    best = r.groupBy("family").agg(F.max_by(F.struct("step", "train", "test"), F.struct(F.round((F.col("train") + F.col("test")) / 2, 8), "test", -F.col("step"))).alias("b"))
    return best.select("family", "b.step", "b.train", "b.test")


@query("""SELECT c_nationkey, arg_max(c_custkey, struct_pack(a := c_acctbal, b := -c_custkey)) AS best FROM customer GROUP BY c_nationkey""")
def tk7_first_max(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))


@query("""WITH l AS (SELECT vec_id, CAST(unnest(range(16)) AS INTEGER) AS bin, CAST(unnest(embedding[1:16]) AS DOUBLE) AS logit FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, bin) AS r FROM l),
    e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS x FROM k WHERE r <= 8),
    p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM e),
    c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
    SELECT vec_id, bin, round(x / sum(x) OVER (PARTITION BY vec_id), 6) AS prob FROM c WHERE before < 0.9""")
def tk12_nucleus(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 16)).alias("bin", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return O.nucleus(e, ["vec_id"], "logit", "bin", 8, 0.9).select("vec_id", "bin", F.round("prob", 6).alias("prob"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('13:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 10""")
def tk13_hash_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("13:"), F.col("doc_id").cast("string")), 256), "doc_id")
    return table(spark, sf, "documents").withColumn("n", F.row_number().over(w)).filter("n <= 10").select("source", "doc_id")
