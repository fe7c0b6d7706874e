"""Driver tables and the engine tables that adapters make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by the path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long step table: events of a user are one episode, in the order of time."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        (F.col("user_id") % 5).alias("variant"),
        F.col("user_id").alias("episode_idx"),
        (F.row_number().over(order) - 1).cast("long").alias("t"),
        F.col("value").alias("reward"),
        (F.col("event_type") == "purchase").alias("success"),
        (F.col("event_type") == "error").alias("fall"),
    )


#: The same table in DuckDB SQL.
STEPS_SQL = """steps AS (
    SELECT user_id % 5 AS variant, user_id AS episode_idx,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
           value AS reward, event_type = 'purchase' AS success, event_type = 'error' AS fall
    FROM events)"""


def episode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout results: an order is one episode of a family (region), variant (nation), seed and checkpoint step."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    dims = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(dims), c.c_nationkey == dims.n_nationkey)
        .select(
            F.col("r_name").alias("family"),
            F.col("n_name").alias("variant"),
            (F.col("o_custkey") % 3).alias("seed"),
            F.year("o_orderdate").cast("long").alias("step"),
            F.when(F.col("n_nationkey") % 4 == 0, "test").otherwise("train").alias("split"),
            F.col("o_orderkey").alias("episode_idx"),
            (F.col("o_orderstatus") == "F").alias("success"),
            F.col("o_totalprice").alias("ret"),
            (F.col("o_orderkey") % 100 + 1).alias("length"),
        )
    )


RESULTS_SQL = """results AS (
    SELECT r_name AS family, n_name AS variant, o_custkey % 3 AS seed, CAST(year(o_orderdate) AS BIGINT) AS step,
           CASE WHEN n_nationkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, o_orderkey AS episode_idx,
           o_orderstatus = 'F' AS success, o_totalprice AS ret, o_orderkey % 100 + 1 AS length
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""


def actions(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """Actions of ``dims`` floats from the embeddings, by variant (label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("episode_idx"), F.col("label").cast("long").alias("variant"), F.slice("embedding", 1, dims).alias("action"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions spread over a map of 11 by 9 unit cells, centred at the origin."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("pos_id"),
        ((F.col("p_partkey") * 37 % 1100) / 100.0 - 5.5).alias("x"),
        ((F.col("p_partkey") * 53 % 900) / 100.0 - 4.5).alias("y"),
    )


POSITIONS_SQL = """positions AS (
    SELECT p_partkey AS pos_id, (p_partkey * 37 % 1100) / 100.0 - 5.5 AS x, (p_partkey * 53 % 900) / 100.0 - 4.5 AS y FROM part)"""


def grid(spark: SparkSession, sf_dir: str, rows: int = 9, cols: int = 11) -> DataFrame:
    """Cells of synthetic maps, one for each ten suppliers: a walled border, pillars at even places and some walls between them."""
    r = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).cast("long").alias("map_id")).distinct()
    r = r.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    r = r.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1)
    pillar = (F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)
    extra = ((F.col("row") + F.col("col")) % 2 == 1) & ((F.col("row") * 7 + F.col("col") * 3 + F.col("map_id") * 5) % 11 == 0)
    return r.withColumn("is_free", ~(border | pillar | extra))


GRID_SQL = """grid AS (
    SELECT m.map_id, r.row, c.col, NOT (r.row = 0 OR c.col = 0 OR r.row = 8 OR c.col = 10 OR (r.row % 2 = 0 AND c.col % 2 = 0)
           OR ((r.row + c.col) % 2 = 1 AND (r.row * 7 + c.col * 3 + m.map_id * 5) % 11 = 0)) AS is_free
    FROM (SELECT DISTINCT CAST(s_suppkey // 10 AS BIGINT) AS map_id FROM supplier) m, range(9) r(row), range(11) c(col))"""
