"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.operators import ordered as O
from stridelake.plans.registry import query
from stridelake.sources.tables import RESULTS_SQL, STEPS_SQL, episode_results, steps, table


@query("""SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def jn1_inner(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def jn2_dimension(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    dim = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 rows at any scale
    return c.join(F.broadcast(dim), c.c_nationkey == dim.n_nationkey).select("c_custkey", "n_name", "r_name")


@query("""SELECT p_partkey, coalesce(CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_acctbal END, p_retailprice) AS reference FROM part LEFT JOIN supplier s ON p_partkey = s.s_suppkey""")
def jn3_override(spark: SparkSession, sf: str) -> DataFrame:
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier").filter("s_suppkey % 2 = 0")
    return p.join(s, p.p_partkey == s.s_suppkey, "left").select("p_partkey", F.coalesce("s_acctbal", "p_retailprice").alias("reference"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def jn4_semi(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def jn5_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_right, b.k IS NULL AS only_left FROM (SELECT DISTINCT c_nationkey AS k FROM customer) a
    FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k""")
def jn6_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("a")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("k"), F.col("a").isNull().alias("only_right"), F.col("b").isNull().alias("only_left"))


@query("""SELECT n_name, r_name FROM nation, region WHERE n_regionkey <> r_regionkey""")
def jn7_pair_space(spark: SparkSession, sf: str) -> DataFrame:
    """A pair space of two fixed dimensions (25 by 5 rows at any scale)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.crossJoin(F.broadcast(r)).filter("n_regionkey <> r_regionkey").select("n_name", "r_name")


@query(f"""WITH {STEPS_SQL}, e AS (SELECT variant, episode_idx, count(*) AS n FROM steps GROUP BY ALL),
    p AS (SELECT variant, episode_idx, sum(n) OVER w - n AS ps, sum(n) OVER w AS pe FROM e WINDOW w AS (PARTITION BY variant ORDER BY episode_idx)),
    i AS (SELECT unnest(range(CAST(ceil(max(pe) / 300.0) AS BIGINT))) AS shard FROM p),
    s AS (SELECT shard, shard * 300 AS ss, (shard + 1) * 300 AS se FROM i)
    SELECT variant, episode_idx, shard, CAST(greatest(ps, ss) AS BIGINT) AS lo, CAST(least(pe, se) AS BIGINT) AS hi FROM p JOIN s ON ps < se AND ss < pe""")
def jn8_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("variant").orderBy("episode_idx")
    p = e.withColumn("pe", F.sum("n").over(w)).withColumn("ps", F.col("pe") - F.col("n")).drop("n")
    last = F.greatest(F.lit(0), F.ceil(F.max("pe") / 300) - 1)  # as many shards as the longest variant fills
    s = p.agg(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("shard")).select("shard", (F.col("shard") * 300).alias("ss"), ((F.col("shard") + 1) * 300).alias("se"))
    return O.interval_overlap(p, s, 300).select("variant", "episode_idx", "shard", "lo", "hi")


@query("""SELECT p_brand, p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand
    AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""")
def jn9_pareto(spark: SparkSession, sf: str) -> DataFrame:
    return O.pareto(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", "p_retailprice", "p_size")


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT family, step, round(avg(CAST(success AS INTEGER)), 6) AS v FROM results GROUP BY ALL)
    SELECT family, step, next_step, round(next_v - v, 6) AS gain FROM (
    SELECT *, lead(step) OVER w AS next_step, lead(v) OVER w AS next_v FROM r WINDOW w AS (PARTITION BY family ORDER BY step)) WHERE next_step IS NOT NULL""")
def jn10_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf).groupBy("family", "step").agg(F.round(F.avg(F.col("success").cast("int")), 6).alias("v"))
    w = Window.partitionBy("family").orderBy("step")
    return r.select("family", "step", F.lead("step").over(w).alias("next_step"), F.round(F.lead("v").over(w) - F.col("v"), 6).alias("gain")).filter("next_step is not null")


@query(f"""WITH {RESULTS_SQL}, r AS (SELECT family, seed, step, round(avg(CAST(success AS INTEGER)), 6) AS v FROM results GROUP BY ALL)
    SELECT a.family, a.seed, round(b.v - a.v, 6) AS diff FROM r a JOIN r b ON a.family = b.family AND a.seed = b.seed AND a.step = 1993 AND b.step = 1996""")
def jn11_paired(spark: SparkSession, sf: str) -> DataFrame:
    r = episode_results(spark, sf).groupBy("family", "seed", "step").agg(F.round(F.avg(F.col("success").cast("int")), 6).alias("v"))
    a, b = r.filter("step = 1993").drop("step"), r.filter("step = 1996").drop("step").withColumnRenamed("v", "w")
    return a.join(b, ["family", "seed"]).select("family", "seed", F.round(F.col("w") - F.col("v"), 6).alias("diff"))


@query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def jn12_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.event_type", "e.value")


@query(f"""WITH {RESULTS_SQL}, c AS (SELECT family, seed, count(DISTINCT variant) AS n FROM results GROUP BY ALL)
    SELECT a.family, a.seed, a.n = b.n AS consistent FROM c a JOIN c b ON a.family = b.family AND b.seed = 0""")
def jn13_consistency(spark: SparkSession, sf: str) -> DataFrame:
    c = episode_results(spark, sf).groupBy("family", "seed").agg(F.countDistinct("variant").alias("n"))
    base = c.filter("seed = 0").select("family", F.col("n").alias("n0"))
    return c.join(F.broadcast(base), "family").select("family", "seed", (F.col("n") == F.col("n0")).alias("consistent"))
