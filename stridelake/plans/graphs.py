"""Queries: graphs on grid maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import grid as G
from stridelake.plans.registry import query
from stridelake.sources.tables import GRID_SQL, grid, table

_F = f"""{GRID_SQL}, f AS (SELECT map_id, row, col, row * 11 + col AS c FROM grid WHERE is_free)"""
_E = f"""{_F}, e AS (SELECT a.map_id, a.c AS a, b.c AS b, CASE WHEN b.row < a.row THEN 0 WHEN b.row > a.row THEN 1 WHEN b.col < a.col THEN 2 ELSE 3 END AS dir
    FROM f a JOIN f b ON a.map_id = b.map_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1)"""
_D = f"""RECURSIVE {_E}, walk AS (SELECT map_id, c AS s, c, 0 AS d FROM f UNION SELECT w.map_id, w.s, e.b, w.d + 1 FROM walk w JOIN e ON e.map_id = w.map_id AND e.a = w.c WHERE w.d < 40),
    dist AS (SELECT map_id, s, c, min(d) AS d FROM walk GROUP BY ALL)"""

_PAIR = ["map_id", "start_row", "start_col", "goal_row", "goal_col"]
_RANKED = [*_PAIR, "path_len", "away_steps", "distractor_exits", "difficulty"]


@query(f"""WITH {_F} SELECT map_id, row, col FROM f""")
def exp5_free_cells(spark: SparkSession, sf: str) -> DataFrame:
    return G.free_cells(grid(spark, sf))


@query(f"""WITH {_E} SELECT map_id, a // 11 AS row, a % 11 AS col, b // 11 AS nrow, b % 11 AS ncol, CAST(dir AS INTEGER) AS dir FROM e""")
def exp5_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.edges(grid(spark, sf))


@query(f"""WITH {_F}, n AS (SELECT map_id, count(*) AS n FROM f GROUP BY map_id) SELECT map_id, n * (n - 1) AS pairs FROM n""")
def exp6_pair_count(spark: SparkSession, sf: str) -> DataFrame:
    return G.free_cells(grid(spark, sf)).groupBy("map_id").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("pairs"))


@query(f"""WITH {_D} SELECT map_id, CAST(s // 11 AS INTEGER) AS start_row, CAST(s % 11 AS INTEGER) AS start_col, CAST(c // 11 AS INTEGER) AS row, CAST(c % 11 AS INTEGER) AS col, CAST(d AS INTEGER) AS d FROM dist""")
def gr1_distances(spark: SparkSession, sf: str) -> DataFrame:
    return G.distances(grid(spark, sf)).drop("parent_row", "parent_col")


@query()
def gr2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical paths by the order of the search, with turns and steps away; tested against a plain search."""
    return G.pairs(grid(spark, sf), [*_PAIR, "path_len", "turns", "away_steps"])


_C = f"""WITH {_D}, comp AS (SELECT map_id, c, min(s) AS component FROM dist GROUP BY ALL)"""


@query(f"""{_C} SELECT map_id, CAST(c // 11 AS INTEGER) AS row, CAST(c % 11 AS INTEGER) AS col, CAST(component AS INTEGER) AS component FROM comp""")
def gr3_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(grid(spark, sf))


@query(f"""{_C} SELECT map_id, c // 11 AS row, c % 11 AS col, (component // 11) * 1000 + component % 11 AS component FROM comp""")
def gr3_label_spreading(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_components(grid(spark, sf), 60)


_MAIN = f"""{_C}, size AS (SELECT map_id, component, count(*) AS n FROM comp GROUP BY ALL), main AS (SELECT map_id, arg_max(component, n * 1000 - component) AS component, max(n) AS n FROM size GROUP BY map_id),
    mc AS (SELECT comp.map_id, comp.c FROM comp JOIN main USING (map_id, component)), deg AS (SELECT mc.map_id, mc.c, count(e.b) AS degree FROM mc LEFT JOIN e ON e.map_id = mc.map_id AND e.a = mc.c GROUP BY ALL)"""


@query(f"""{_MAIN} SELECT main.map_id, CAST(max(d) AS INTEGER) AS diameter FROM main JOIN dist ON dist.map_id = main.map_id JOIN comp ON comp.map_id = main.map_id AND comp.c = dist.s AND comp.component = main.component GROUP BY main.map_id""")
def gr4_diameter(spark: SparkSession, sf: str) -> DataFrame:
    return G.map_metrics(grid(spark, sf)).select("map_id", "diameter")


@query()
def gr5_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Articulation points and bridges; tested against removing each cell and edge."""
    return G.map_metrics(grid(spark, sf)).select("map_id", "articulation_points", "bridges")


@query()
def gr6_corridors(spark: SparkSession, sf: str) -> DataFrame:
    return G.map_metrics(grid(spark, sf)).select("map_id", "corridors", F.round("corridor_mean", 6).alias("corridor_mean"), "corridor_max")


@query(f"""WITH {_E}, g AS (SELECT f.map_id, f.c, count(e.b) AS degree FROM f LEFT JOIN e ON e.map_id = f.map_id AND e.a = f.c GROUP BY ALL)
    SELECT map_id, count(*) AS free, CAST(sum(degree) // 2 AS BIGINT) AS edges, count(*) FILTER (degree = 1) AS deadends, count(*) FILTER (degree = 2) AS corridors, count(*) FILTER (degree = 3) AS forks, count(*) FILTER (degree >= 4) AS crosses FROM g GROUP BY map_id""")
def gr7_degrees(spark: SparkSession, sf: str) -> DataFrame:
    d = G.degrees(grid(spark, sf))
    k = F.col("degree")
    return d.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("free"), F.floor(F.sum(k) / 2).alias("edges"), F.count_if(k == 1).alias("deadends"), F.count_if(k == 2).alias("corridors"), F.count_if(k == 3).alias("forks"), F.count_if(k >= 4).alias("crosses")
    )


@query(f"""{_MAIN} SELECT map_id, CAST(count(*) AS INTEGER) AS free, CAST(sum(degree) // 2 - count(*) + 1 AS INTEGER) AS cycle_rank, CAST(count(*) FILTER (degree = 1) AS INTEGER) AS deadends FROM deg GROUP BY map_id""")
def gr7_cycle_rank(spark: SparkSession, sf: str) -> DataFrame:
    return G.map_metrics(grid(spark, sf)).select("map_id", "free", "cycle_rank", "deadends")


@query()
def gr8_static_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    """All structure figures of the largest component and its static difficulty (also the report struct and table)."""
    return G.map_metrics(grid(spark, sf))


@query()
def gr9_distractors(spark: SparkSession, sf: str) -> DataFrame:
    p = G.pairs(grid(spark, sf), [*_PAIR, "distractor_points", "distractor_exits", "branch_score"])
    return p.withColumn("branch_score", F.round("branch_score", 8)).select(*_PAIR, "distractor_points", "distractor_exits", "branch_score")


@query(f"""WITH {_D} SELECT map_id, CAST(s // 11 AS INTEGER) AS start_row, CAST(s % 11 AS INTEGER) AS start_col, CAST(c // 11 AS INTEGER) AS goal_row, CAST(c % 11 AS INTEGER) AS goal_col, CAST(d AS INTEGER) AS path_len,
    round(d / (d + 20.0::DOUBLE), 8) AS length_score, round(1 - (abs(s // 11 - c // 11) + abs(s % 11 - c % 11)) / d::DOUBLE, 8) AS detour_score FROM dist WHERE d > 0""")
def gr10_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = G.pairs(grid(spark, sf), [*_PAIR, "path_len", "length_score", "detour_score"])
    return p.select(*_PAIR, "path_len", F.round("length_score", 8).alias("length_score"), F.round("detour_score", 8).alias("detour_score"))


@query()
def gr11_hard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    h = G.hard_pairs(G.pairs(grid(spark, sf), [*_PAIR, "path_len", "away_steps"]), 2.0, top=40, longest=20)
    return h.select("map_id", "start_row", "start_col", "goal_row", "goal_col", "path_len", F.round("hard", 8).alias("hard"), F.round("rank_score", 8).alias("rank_score"), F.round("sample_weight", 8).alias("sample_weight"))


@query()
def gr12_map_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    return G.map_difficulty(G.pairs(grid(spark, sf), _RANKED)).withColumn("map_difficulty", F.round("map_difficulty", 8))


@query()
def gr12_eval_pool(spark: SparkSession, sf: str) -> DataFrame:
    p = G.eval_pool(G.pairs(grid(spark, sf), _RANKED), "hard", 3, percent=5.0)
    return p.select("map_id", "start_row", "start_col", "goal_row", "goal_col", F.col("position").cast("long").alias("position"))


@query()
def gr13_perfect_mazes(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("map_id"))
    m = G.mazes(spark, seeds, {"version": "v1", "min_size": 7, "max_size": 15})
    return m.groupBy("map_id").agg(F.count_if("is_free").alias("free"), (F.max("row") + 1).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "is_free"))), lambda s: s["is_free"].cast("string")), ""), 256).alias("map_hash"))


@query(f"""WITH {GRID_SQL}, w AS (SELECT a.map_id, a.row, a.col FROM grid a JOIN grid b ON b.map_id = a.map_id AND b.row = a.row AND b.col BETWEEN a.col AND a.col + 2 WHERE b.is_free GROUP BY ALL HAVING count(*) = 3),
    m AS (SELECT DISTINCT map_id FROM grid) SELECT m.map_id, count(w.row) AS windows FROM m LEFT JOIN w ON w.map_id = m.map_id GROUP BY m.map_id""")
def gr14_free_windows(spark: SparkSession, sf: str) -> DataFrame:
    return G.window_count(grid(spark, sf), 1, 3)


@query()
def gr14_best_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The least penalised of the seeded layouts of each nation, a supplier a seed (also the choice by penalty)."""
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"), "s_nationkey")
    scored = G.layout_penalties(seeds, 9, 11, 0.5, 0.3, {"deadends": (2, 6), "path_len": (18, 30)}).join(seeds, "seed")
    return G.best_layouts(scored, ["s_nationkey"]).withColumn("penalty", F.round("penalty", 6))


@query()
def tk10_diverse_cells(spark: SparkSession, sf: str) -> DataFrame:
    def kernel(g, rows, cols):
        main = G.Graph(max(g.components(), key=lambda p: (len(p), [-x for x in min(p)])))
        return [{"pos": i, "row": r, "col": c} for i, (r, c) in enumerate(G.diverse_cells(main))]

    return G._per_map(grid(spark, sf), kernel, "map_id long, pos int, row int, col int")


@query(f"""WITH {_D}, b AS (SELECT map_id, s, max(d) AS d FROM dist GROUP BY ALL) SELECT b.map_id, b.s // 11 AS row, b.s % 11 AS col, CAST(b.d AS INTEGER) AS d,
    max(c) // 11 AS last_row, max(c) % 11 AS last_col, min(c) // 11 AS first_row, min(c) % 11 AS first_col FROM b JOIN dist x ON x.map_id = b.map_id AND x.s = b.s AND x.d = b.d GROUP BY ALL""")
def tk9_farthest(spark: SparkSession, sf: str) -> DataFrame:
    """The farthest cell of each start under both tie rules: the last and the first in row order."""
    d = G.distances(grid(spark, sf))
    cell = F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    out = d.groupBy("map_id", F.col("start_row").cast("long").alias("row0"), F.col("start_col").cast("long").alias("col0")).agg(
        F.max("d").alias("d"), F.max_by(cell, F.struct("d", "row", "col")).alias("last"), F.max_by(cell, F.struct("d", -F.col("row"), -F.col("col"))).alias("first")
    )
    return out.select("map_id", F.col("row0").alias("row"), F.col("col0").alias("col"), "d", F.col("last.row").alias("last_row"), F.col("last.col").alias("last_col"), F.col("first.row").alias("first_row"), F.col("first.col").alias("first_col"))
