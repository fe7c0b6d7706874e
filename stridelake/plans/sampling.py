"""Queries: sampling, splitting, sharding and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import sampling as S
from stridelake.plans.registry import query
from stridelake.sources.tables import STEPS_SQL, steps, table

_U = "(CAST(('0x' || substr(sha256({}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n_steps"))


_EP = f"{STEPS_SQL}, ep AS (SELECT variant, episode_idx, count(*) AS n_steps FROM steps GROUP BY ALL)"


@query(f"""WITH {_EP}, r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY sha256(variant || ':7:' || episode_idx), episode_idx) AS r, least(count(*) OVER (PARTITION BY variant), 20) AS t FROM ep)
    SELECT variant, episode_idx, CASE WHEN r <= floor(t * 0.9) THEN 'train' ELSE 'val' END AS split FROM r WHERE r <= t""")
def sm1_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split(_episodes(spark, sf), ["variant"], "episode_idx", 7, 0.9, 20).select("variant", "episode_idx", "split")


@query("""SELECT n_name, CAST(CASE n_name WHEN 'NATION_7' THEN 5 WHEN 'NATION_12' THEN 9 ELSE 20 END AS INTEGER) AS keep FROM nation""")
def sm2_keep_overrides(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.createDataFrame([("NATION_7", 5), ("NATION_12", 9)], "n_name string, keep int")
    return S.keep_overrides(table(spark, sf, "nation").select("n_name"), o, "n_name", 20)


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || source || ':' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5""")
def sm3_first_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_by_hash(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 3, 5)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_U.format("'11:' || l_orderkey")} < 0.8 THEN 'train' ELSE 'val' END AS split FROM lineitem""")
def sm4_split_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 11, 0.8)


@query(f"""WITH {_EP} SELECT variant, episode_idx, CAST((row_number() OVER (PARTITION BY variant ORDER BY sha256(variant || ':5:' || episode_idx), episode_idx) - 1) % 4 AS INTEGER) AS part FROM ep""")
def sm5_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return S.round_robin(_episodes(spark, sf), ["variant"], "episode_idx", 5, 4).select("variant", "episode_idx", F.col("part").cast("int").alias("part"))


@query(f"""WITH {_EP}, o AS (SELECT *, sum(n_steps) OVER (PARTITION BY variant ORDER BY sha256(variant || ':9:' || episode_idx), episode_idx) AS pe, sum(n_steps) OVER (PARTITION BY variant) AS total FROM ep),
    p AS (SELECT *, pe - n_steps AS ps, total // 7 AS b, total % 7 AS m FROM o),
    s AS (SELECT p.*, CAST(i AS BIGINT) AS part, i * b + least(i, m) AS ss, (i + 1) * b + least(i + 1, m) AS se FROM p, range(7) r(i))
    SELECT variant, episode_idx, part, CAST(greatest(ss, ps) - ps AS BIGINT) AS start_t, CAST(least(se, pe) - ps AS BIGINT) AS end_t FROM s WHERE ps < se AND ss < pe""")
def sm6_step_shards(spark: SparkSession, sf: str) -> DataFrame:
    return S.step_shards(_episodes(spark, sf), ["variant"], "episode_idx", 9, 7)


@query("""SELECT CAST(r AS BIGINT) AS round, CAST(row_number() OVER (ORDER BY sha256('7:2:' || r), r) - 1 AS INTEGER) AS position FROM range(12) x(r)""")
def sm7_round_order(spark: SparkSession, sf: str) -> DataFrame:
    return S.round_order(spark.range(12).select(F.col("id").alias("round")), 2, 7).withColumn("position", F.col("position").cast("int"))


@query("""SELECT n_name AS variant, CAST((row_number() OVER (ORDER BY n_name) - 1) % 4 AS BIGINT) AS rank FROM nation""")
def sm8_rank_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The variants are a dimension of fixed size."""
    return S.deal_ranks(table(spark, sf, "nation").select(F.col("n_name").alias("variant")), "variant", 4)


@query("""SELECT doc_id, source, round(1.0 / count(*) OVER (PARTITION BY source), 10) AS weight FROM documents""")
def sm9_inverse_size_weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.inverse_size_weights(table(spark, sf, "documents").select("doc_id", "source"), ["source"]).select("doc_id", "source", F.round("weight", 10).alias("weight"))


@query(f"""WITH c AS (SELECT n_name, n_nationkey % 4 AS w FROM nation WHERE n_nationkey % 4 > 0), i AS (SELECT n_name, sum(w) OVER (ORDER BY n_name) - w AS lo, sum(w) OVER (ORDER BY n_name) AS hi FROM c),
    d AS (SELECT CAST(draw AS BIGINT) AS draw, {_U.format("'21:' || draw")} * (SELECT max(hi) FROM i) AS x FROM range(500) r(draw))
    SELECT draw, n_name FROM d JOIN i ON x >= lo AND x < hi""")
def sm9_weighted_draws(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "nation").select("n_name", (F.col("n_nationkey") % 4).alias("w"))
    return S.weighted_draws(c, "w", ["n_name"], 500, 21).select("draw", "n_name")


@query(f"""WITH {_EP}, o AS (SELECT variant, episode_idx, row_number() OVER (PARTITION BY variant ORDER BY sha256(variant || ':7:' || episode_idx), episode_idx) - 1 AS position FROM ep),
    n AS (SELECT variant, count(*) AS n, ((count(*) + 63) // 64) * 64 AS size FROM ep GROUP BY variant), m AS (SELECT variant, n, unnest(range(n, size)) AS place FROM n),
    x AS (SELECT variant, place, CAST(floor({_U.format("variant || ':7:pad:' || place")} * n) AS BIGINT) AS position FROM m)
    SELECT variant, position, episode_idx FROM o UNION ALL SELECT x.variant, x.place, o.episode_idx FROM x JOIN o USING (variant, position)""")
def sm10_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Every variant's episodes, filled up to whole batches of 64."""
    return S.pad_groups(_episodes(spark, sf), ["variant"], "episode_idx", 7, F.ceil(F.col("n") / 64) * 64)


@query(f"""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY -ln(greatest({_U.format("'17:' || p_brand || ':' || p_partkey")}, 1.1102230246251565e-16)) / p_size, p_partkey) AS r
    FROM part WHERE p_size > 0) WHERE r <= 6""")
def sm11_weighted_top(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size > 0")
    return S.weighted_top(p, ["p_brand"], "p_partkey", "p_size", 17, 6).select("p_brand", "p_partkey")


@query(f"""WITH {_EP}, p AS (SELECT c_nationkey % 5 AS variant, c_custkey, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY sha256('4:' || c_custkey), c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey % 5) AS n FROM customer)
    SELECT ep.variant, ep.episode_idx, p.c_custkey FROM ep JOIN p ON p.variant = ep.variant AND p.pos = ep.episode_idx % p.n""")
def sm12_permutation_cycle(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).cast("long").alias("variant"), "c_custkey")
    return S.permutation_cycle(items, ["variant"], "c_custkey", 4, _episodes(spark, sf), "episode_idx").select("variant", "episode_idx", "c_custkey")


@query("""SELECT p_partkey, round(p_size / sum(p_size) OVER (PARTITION BY p_brand), 10) AS probability FROM part""")
def sm13_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return S.probabilities(table(spark, sf, "part"), ["p_brand"], "p_size").select("p_partkey", F.round("probability", 10).alias("probability"))


_DRAW = "'{tag}' || ':' || variant || ':' || episode_idx || ':' || t"


def _u(tag: str) -> str:
    return _U.format("'31:" + tag + ":' || variant || ':' || episode_idx || ':' || t")


_GOALS = f"""g AS (SELECT s.*, last_t, CASE WHEN {_u("kind")} < 0.2 THEN 'current' WHEN {_u("kind")} < 0.2::DOUBLE + 0.5::DOUBLE THEN 'future' ELSE 'random' END AS goal_kind
    FROM steps s JOIN (SELECT variant, episode_idx, max(t) AS last_t FROM steps GROUP BY ALL) USING (variant, episode_idx))"""


@query(f"""WITH {STEPS_SQL}, {_GOALS} SELECT variant, episode_idx, t, goal_kind, CAST(CASE goal_kind WHEN 'current' THEN t
    WHEN 'future' THEN least(t + 1 + floor({_u("step")} * (last_t - t)), last_t) END AS BIGINT) AS goal_t FROM g""")
def sm14_relabel_goals(spark: SparkSession, sf: str) -> DataFrame:
    return S.relabel_goals(steps(spark, sf), 31, 0.2, 0.5, None).select("variant", "episode_idx", "t", "goal_kind", "goal_t")


@query(f"""WITH {STEPS_SQL}, {_GOALS}, h AS (SELECT *, CAST(CASE goal_kind WHEN 'current' THEN t WHEN 'future' THEN least(t + 1 + floor({_u("step")} * (last_t - t)), last_t) END AS BIGINT) AS goal_t FROM g)
    SELECT variant, episode_idx, t, CASE WHEN goal_t = t THEN 1.0 ELSE 0.0 END::DOUBLE AS success, CASE WHEN goal_t = t THEN 0.0 ELSE -1.0 END::DOUBLE AS reward, CASE WHEN goal_t = t THEN 0.0 ELSE 1.0 END::DOUBLE AS mask FROM h""")
def sm15_goal_batches(spark: SparkSession, sf: str) -> DataFrame:
    g = S.relabel_goals(steps(spark, sf), 31, 0.2, 0.5, None)
    ok = F.coalesce((F.col("goal_t") == F.col("t")).cast("double"), F.lit(0.0))
    return g.select("variant", "episode_idx", "t", ok.alias("success"), (ok - 1.0).alias("reward"), (1.0 - ok).alias("mask"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('23:' || source || ':' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3""")
def sm16_estimate_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_by_hash(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 23, 3)


@query("""WITH t AS (SELECT o_orderstatus, count(*) AS target FROM orders GROUP BY o_orderstatus)
    SELECT o_orderstatus, CAST(i AS BIGINT) AS worker, CAST(target // 8 + CASE WHEN i < target % 8 THEN 1 ELSE 0 END AS BIGINT) AS share FROM t, range(8) r(i)""")
def sm17_split_target(spark: SparkSession, sf: str) -> DataFrame:
    """The episodes of each kind, shared out to eight workers."""
    t = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("target"))
    return S.split_rows(t, "target", 8).select("o_orderstatus", "worker", "share")
