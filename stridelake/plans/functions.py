"""Queries: scalar and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.functions import actions as A
from stridelake.functions import geometry as G
from stridelake.functions import text as T
from stridelake.plans.registry import query
from stridelake.sources.tables import GRID_SQL, POSITIONS_SQL, actions, grid, positions, table

_CELL = "least(greatest(CAST(floor(4.5 - y) AS BIGINT), 0), 8) AS r0, least(greatest(CAST(floor(x + 5.5) AS BIGINT), 0), 10) AS c0"


@query(f"""WITH {POSITIONS_SQL}, {GRID_SQL}, p AS (SELECT *, {_CELL} FROM positions), g AS (SELECT * FROM grid WHERE map_id = 0),
    d AS (SELECT p.pos_id, g.row, g.col, row_number() OVER (PARTITION BY p.pos_id ORDER BY (p.x - (g.col + 0.5 - 5.5)) * (p.x - (g.col + 0.5 - 5.5)) + (p.y - (4.5 - (g.row + 0.5))) * (p.y - (4.5 - (g.row + 0.5))), g.row, g.col) AS n FROM p JOIN g ON g.is_free)
    SELECT p.pos_id, CASE WHEN g.is_free THEN p.r0 ELSE d.row END AS row, CASE WHEN g.is_free THEN p.c0 ELSE d.col END AS col FROM p JOIN g ON g.row = p.r0 AND g.col = p.c0 JOIN d ON d.pos_id = p.pos_id AND d.n = 1""")
def sc1_position_to_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of positions, snapped out of walls (also the nearest-free-cell rule)."""
    return G.snap(positions(spark, sf), grid(spark, sf).filter("map_id = 0"), 9, 11).select("pos_id", "row", "col")


@query(f"""WITH {POSITIONS_SQL}, p AS (SELECT *, {_CELL} FROM positions) SELECT pos_id, CAST(c0 + 0.5 - 5.5 AS DOUBLE) AS cx, CAST(4.5 - (r0 + 0.5) AS DOUBLE) AS cy FROM p""")
def sc2_cell_center(spark: SparkSession, sf: str) -> DataFrame:
    r, c = G.to_cell(F.col("x"), F.col("y"), 9, 11)
    cx, cy = G.cell_center(r, c, 9, 11)
    return positions(spark, sf).select("pos_id", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query(f"""WITH {POSITIONS_SQL}, p AS (SELECT *, {_CELL} FROM positions), q AS (SELECT *, c0 + 0.5 - 5.5 AS cx, 4.5 - (r0 + 0.5) AS cy FROM p)
    SELECT pos_id, CAST((x - (cx - 0.5) <= 0.255)::INT + 2 * ((cx + 0.5) - x <= 0.255)::INT + 4 * (y - (cy - 0.5) <= 0.255)::INT + 8 * ((cy + 0.5) - y <= 0.255)::INT AS INTEGER) AS mask FROM q""")
def sc3_near_mask(spark: SparkSession, sf: str) -> DataFrame:
    r, c = G.to_cell(F.col("x"), F.col("y"), 9, 11)
    return positions(spark, sf).select("pos_id", G.near_mask(F.col("x"), F.col("y"), G.cell_bounds(r, c, 9, 11), 0.255).alias("mask"))


def _status_sql(case: str) -> str:
    """An independent form: neighbour, sides and diagonals are looked up by joins instead of in lists."""
    wall = "(SELECT map_id, row AS r, col AS c, NOT is_free AS w FROM grid)"
    look = lambda a, dr, dc: f"LEFT JOIN {wall} {a} ON {a}.map_id = k.map_id AND {a}.r = k.row + {dr} AND {a}.c = k.col + {dc}"
    return f"""WITH {GRID_SQL}, dirs AS (SELECT * FROM (VALUES ('up', -1, 0, 0, -1), ('down', 1, 0, 0, -1), ('left', 0, -1, -1, 0), ('right', 0, 1, -1, 0)) v(direction, dr, dc, sr, sc)),
    k AS (SELECT map_id, row, col, direction, dr, dc, sr, sc, CAST(m AS INTEGER) AS mask FROM grid, dirs, range(16) x(m)),
    f AS (SELECT k.*, coalesce(d.w, true) AS direct, coalesce(s1.w, true) AS side1, coalesce(s2.w, true) AS side2, coalesce(g1.w, true) AS diag1, coalesce(g2.w, true) AS diag2,
      CASE WHEN dc <> 0 THEN mask & 8 > 0 ELSE mask & 1 > 0 END AS near1, CASE WHEN dc <> 0 THEN mask & 4 > 0 ELSE mask & 2 > 0 END AS near2,
      CASE WHEN dr < 0 THEN mask & 4 > 0 WHEN dr > 0 THEN mask & 8 > 0 WHEN dc < 0 THEN mask & 2 > 0 ELSE mask & 1 > 0 END AS opposite
      FROM k {look("d", "k.dr", "k.dc")} {look("s1", "k.sr", "k.sc")} {look("s2", "(-k.sr)", "(-k.sc)")} {look("g1", "k.dr + k.sr", "k.dc + k.sc")} {look("g2", "k.dr - k.sr", "k.dc - k.sc")})
    SELECT map_id, row, col, direction, mask, CAST({case} AS INTEGER) AS status FROM f"""


_CORNER = "((near1 AND NOT side1 AND diag1) OR (near2 AND NOT side2 AND diag2))"


def _status(version: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return G.status_table(grid(spark, sf), version).drop("ord")

    run.__name__ = f"sc4_wall_sensing_{version}"
    return run


for _v, _case in {
    "v1": "CASE WHEN direct THEN 1 ELSE 0 END",
    "v2": "CASE WHEN direct OR (near1 AND diag1) OR (near2 AND diag2) THEN 1 ELSE 0 END",
    "v3": f"CASE WHEN direct OR {_CORNER} THEN 1 ELSE 0 END",
    "v4": f"CASE WHEN direct THEN CASE WHEN opposite THEN 0 ELSE 1 END WHEN {_CORNER} THEN 1 ELSE 0 END",
    "v5": f"CASE WHEN direct THEN 1 WHEN {_CORNER} THEN 2 ELSE 0 END",
}.items():
    query(_status_sql(_case))(_status(_v))


def _sensed(spark: SparkSession, sf: str, version: str = "v1") -> DataFrame:
    p = positions(spark, sf)
    p = G.snap(p, grid(spark, sf).filter("map_id = 0"), 9, 11)
    p = p.withColumn("mask", G.near_mask(F.col("x"), F.col("y"), G.cell_bounds(F.col("row"), F.col("col"), 9, 11), 0.255))
    t = G.status_table(grid(spark, sf).filter("map_id = 0"), version)
    t = t.groupBy("row", "col", "mask").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "status"))), lambda s: s["status"]).alias("statuses"))
    return p.join(F.broadcast(t), ["row", "col", "mask"])


@query()
def sc6_sensing(spark: SparkSession, sf: str) -> DataFrame:
    """Snap, near sides, status look-up and text in one plan; each part has its own oracle."""
    s = _sensed(spark, sf, "v5")
    return s.select("pos_id", "row", "col", G.sensing_text(F.col("row"), F.col("col"), F.lit(1), F.lit(9), F.col("statuses")).alias("en"), G.sensing_text(F.col("row"), F.col("col"), F.lit(1), F.lit(9), F.col("statuses"), zh=True).alias("zh"))


def _grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    line = g.groupBy("map_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.when(F.col("is_free"), 0).otherwise(1).alias("v")))), lambda s: s["v"]).alias("line"))
    return line.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]).alias("grid"))


_ROWS = f"""{GRID_SQL}, m AS (SELECT map_id, row, col, CASE WHEN row = 1 AND col = 1 THEN 2 WHEN row = 7 AND col = 9 THEN 3 WHEN is_free THEN 0 ELSE 1 END AS v FROM grid)"""


@query(f"""WITH {_ROWS}, l AS (SELECT map_id, row, string_agg(CAST(v AS VARCHAR), '' ORDER BY col) AS line FROM m GROUP BY ALL)
    SELECT map_id, string_agg(line, chr(10) ORDER BY row) AS picture FROM l GROUP BY map_id""")
def sc9_dynamic_map(spark: SparkSession, sf: str) -> DataFrame:
    m = _grid_rows(spark, sf)
    return m.select("map_id", G.map_text(G.dynamic_map(F.col("grid"), F.lit(1), F.lit(1), F.lit(7), F.lit(9))).alias("picture"))


@query(f"""WITH {GRID_SQL}, f AS (SELECT m.map_id, r * 13 + c AS i, coalesce(CASE WHEN g.is_free THEN 0 WHEN NOT g.is_free THEN 1 END, -1) AS v
    FROM (SELECT DISTINCT map_id FROM grid) m(map_id), range(10) x(r), range(13) y(c) LEFT JOIN grid g ON g.map_id = m.map_id AND g.row = r AND g.col = c)
    SELECT map_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS features FROM f GROUP BY map_id""".replace("FROM (SELECT DISTINCT map_id FROM grid) m(map_id), range(10) x(r), range(13) y(c) LEFT JOIN", "FROM (SELECT * FROM (SELECT DISTINCT map_id FROM grid) m(map_id), range(10) x(r), range(13) y(c)) m LEFT JOIN"))
def sc10_map_features(spark: SparkSession, sf: str) -> DataFrame:
    return _grid_rows(spark, sf).select("map_id", F.array_join(G.map_features(F.col("grid"), 10, 13), ",").alias("features"))


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + embedding[2], 6) AS xy, CAST(6 AS INTEGER) AS dims FROM embeddings""")
def sc11_vectorise(spark: SparkSession, sf: str) -> DataFrame:
    """State of four numbers and a goal of two as one vector."""
    e = table(spark, sf, "embeddings")
    v = F.concat(F.slice("embedding", 1, 4), F.slice("embedding", 5, 2))
    return e.select("vec_id", F.round(v[0].cast("double") + v[1].cast("double"), 6).alias("xy"), F.size(v).alias("dims"))


@query("""WITH m AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS s FROM (SELECT unnest(range(4)) AS i, CAST(unnest(embedding[1:4]) AS DOUBLE) AS v FROM embeddings) GROUP BY i),
    l AS (SELECT vec_id, unnest(range(4)) AS i, CAST(unnest(embedding[1:4]) AS DOUBLE) AS v FROM embeddings)
    SELECT vec_id, round(sum((v - m) / s), 4) AS total FROM l JOIN m USING (i) GROUP BY vec_id""")
def sc12_standardise(spark: SparkSession, sf: str) -> DataFrame:
    from stridelake.operators.metrics import moments

    a = actions(spark, sf, 4)
    m = moments(a, "action").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))), lambda s: F.struct(s["mean"].alias("m"), s["std"].alias("s"))).alias("ms"))
    z = F.zip_with("action", "ms", lambda v, s: (v.cast("double") - s["m"]) / s["s"])
    return a.crossJoin(F.broadcast(m)).select(F.col("episode_idx").alias("vec_id"), F.round(F.aggregate(z, F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query("""WITH l AS (SELECT vec_id, unnest(range(8)) AS i, least(greatest(CAST(unnest(embedding[1:8]) AS DOUBLE), -1), 1) AS v FROM embeddings),
    b AS (SELECT vec_id, i, CAST(least(greatest(round_even((v + 1) / 2 * 255, 0), 0), 255) AS INTEGER) AS b FROM l)
    SELECT vec_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS bins, round(sum(-1 + b / 255.0::DOUBLE * 2), 6) + 0.0 AS back FROM b GROUP BY vec_id""")
def sc14_action_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = F.transform("action", lambda v: A.to_bin(v, 256))
    a = actions(spark, sf).withColumn("b", b)
    back = F.aggregate(F.transform("b", lambda x: A.from_bin(x, 256)), F.lit(0.0), lambda x, y: x + y)
    return a.select(F.col("episode_idx").alias("vec_id"), F.array_join("b", ",").alias("bins"), (F.round(back, 6) + 0.0).alias("back"))


@query("""WITH l AS (SELECT vec_id, unnest(range(4)) AS i, least(greatest(CAST(unnest(embedding[1:4]) AS DOUBLE), -1), 1) AS v FROM embeddings),
    b AS (SELECT vec_id, i, CAST(round_even((v + 1) / 2 * 255, 0) AS INTEGER) AS b FROM l)
    SELECT vec_id, string_agg('<act_' || lpad(CAST(b AS VARCHAR), 3, '0') || '>', '' ORDER BY i) AS tokens, true AS ok, round(sum(-1 + b / 255.0::DOUBLE * 2), 6) AS total FROM b GROUP BY vec_id""")
def sc15_action_tokens(spark: SparkSession, sf: str) -> DataFrame:
    a = actions(spark, sf, 4).withColumn("tokens", A.bin_tokens(F.col("action"), 256))
    p = A.parse_bin_tokens(F.col("tokens"), 4, 256)
    return a.select(F.col("episode_idx").alias("vec_id"), "tokens", p["ok"].alias("ok"), F.round(F.aggregate(p["action"], F.lit(0.0), lambda x, y: x + y), 6).alias("total"))


@query("""WITH l AS (SELECT vec_id, unnest(range(2)) AS i, CAST(unnest(embedding[1:2]) AS DOUBLE) AS v FROM embeddings),
    t AS (SELECT vec_id, i, CAST(least(greatest(round_even(v * 100, 0), -100), 100) AS INTEGER) AS n FROM l)
    SELECT vec_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS text, true AS ok, round(sum(n / 100.0::DOUBLE), 6) AS total FROM t GROUP BY vec_id""")
def sc17_action_text(spark: SparkSession, sf: str) -> DataFrame:
    a = actions(spark, sf, 2).withColumn("text", A.action_text(F.transform("action", lambda v: v.cast("double"))))
    p = A.parse_action(F.concat(F.lit("move "), "text"), 2)
    return a.select(F.col("episode_idx").alias("vec_id"), "text", p["ok"].alias("ok"), F.round(p["action"][0] + p["action"][1], 6).alias("total"))


@query("""SELECT conv_id, turn, CASE WHEN turn > 0 THEN chr(10) || '## History' || chr(10) || '1: ' || CAST(length(p) AS VARCHAR) ELSE '' END AS block
    FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)""")
def sc19_history_block(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("p", F.lag("text").over(w))
    entries = F.filter(F.array(F.struct(F.lit(1).alias("ago"), F.col("p").alias("text"))), lambda e: e["text"].isNotNull())
    return c.select("conv_id", "turn", T.history_block(entries, lambda e: F.concat(e["ago"].cast("string"), F.lit(": "), F.length(e["text"]).cast("string"))).alias("block"))


@query("""SELECT doc_id, 'Read {' || source || '} in ' || lang || ', ' || n_chars || ' characters.' AS prompt, '<user>' || source || '</turn><assistant>' || lang || '</turn>' AS chat FROM documents""")
def sc20_templates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = T.render("Read {{{source}}} in {lang}, {n_chars} characters.", {c: F.col(c) for c in ("source", "lang", "n_chars")})
    return d.select("doc_id", text.alias("prompt"), T.training_chat(F.col("source"), F.col("lang")).alias("chat"))


@query("""SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) AS place, string_agg(CASE WHEN i < p_partkey % 5 THEN '-1' WHEN i < p_partkey % 5 + 2 THEN CAST(i - p_partkey % 5 + 10 AS VARCHAR) ELSE '-1' END, ',' ORDER BY i) AS bins
    FROM part, range(8) r(i) GROUP BY p_partkey""")
def sc22_label_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Bin labels placed at the first place where the ids of the action occur."""
    p = table(spark, sf, "part")
    at = (F.col("p_partkey") % 5).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((i >= at) & (i < at + 2), i - at + 500).otherwise(7))
    p = p.withColumn("ids", ids).withColumn("needle", F.array(F.lit(500), F.lit(501)))
    labels = T.bin_labels(F.col("ids"), F.col("needle"), F.array(F.lit(10), F.lit(11)))
    return p.select("p_partkey", T.find_sub(F.col("ids"), F.col("needle")).alias("place"), F.array_join(labels, ",").alias("bins"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 97 AS batch, CAST(o_orderkey % 6 + 1 AS INTEGER) AS n FROM orders)
    SELECT o_orderkey, batch, CAST(max(n) OVER (PARTITION BY batch) AS INTEGER) AS width, CAST(max(n) OVER (PARTITION BY batch) - n AS INTEGER) AS padded FROM s""")
def sc24_collate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    n = (F.col("o_orderkey") % 6 + 1).cast("int")
    s = o.select("o_orderkey", (F.col("o_orderkey") % 97).alias("batch"), F.array_repeat(F.lit(5), n).alias("ids"), F.array_repeat(F.lit(6), n).alias("labels"))
    c = T.collate(s, "batch", {"ids": 0, "labels": T.IGNORE})
    return c.select("o_orderkey", "batch", F.size("ids").alias("width"), F.size(F.filter("labels", lambda v: v == T.IGNORE)).alias("padded"))


@query("""SELECT doc_id, sha256('["v1",' || doc_id || ',"size"]') AS h FROM documents""")
def sc25_stable_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit('["v1",'), F.col("doc_id").cast("string"), F.lit(',"size"]')), 256).alias("h"))


@query("""SELECT n_nationkey, 'seed-map-' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'maze-dense-v' ELSE 'maze-sparse-v' END || n_regionkey AS path FROM nation""")
def sc27_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "dense").otherwise("sparse")
    raw = F.concat(F.lit("maze-v"), F.col("n_regionkey").cast("string"))
    return n.select("n_nationkey", F.concat(F.lit("seed-map-"), F.col("n_nationkey").cast("string")).alias("name"), T.typed_name(raw, kind).alias("path"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 5 END AS INTEGER) AS n_moves, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'R' END AS first FROM orders""")
def sc28_moves(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("o_orderkey") % 5).cast("int")
    text = F.when(k == 0, "path: stay here").otherwise(F.concat(F.lit("uuu PATH: "), F.array_join(F.array_repeat(F.lit("r"), k), " ")))
    m = T.moves(text)
    return table(spark, sf, "orders").select("o_orderkey", F.size(m).alias("n_moves"), F.get(m, F.lit(0)).alias("first"))


@query("""WITH l AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(8) r(i)), e AS (SELECT vec_id, i, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM l)
    SELECT vec_id, CAST(i AS INTEGER) AS bin, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS prob FROM e""")
def sc34_softmax(spark: SparkSession, sf: str) -> DataFrame:
    a = actions(spark, sf)
    p = A.softmax(F.transform("action", lambda v: v.cast("double")))
    return a.select(F.col("episode_idx").alias("vec_id"), F.posexplode(p).alias("bin", "prob")).withColumn("prob", F.round("prob", 6))


@query("""WITH w AS (SELECT p_partkey, i, exp(-((i - p_size % 10) * (i - p_size % 10)) / 2.0) AS w FROM part, range(10) r(i))
    SELECT p_partkey, CAST(i AS INTEGER) AS bin, round(w / sum(w) OVER (PARTITION BY p_partkey), 6) AS target FROM w""")
def sc32_soft_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.posexplode(A.soft_targets(F.col("p_size") % 10, 10, 1.0)).alias("bin", "target")).withColumn("target", F.round("target", 6))


@query("""SELECT vec_id, round(0.3 + 0.5 * (ln(5.0) + ln(pi())) + (lgamma(2.5) - lgamma(3.0)) + 3.0 * ln(1 + pow((CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE)) / exp(0.3), 2) / 5.0), 5) AS student,
    round(0.5 * (pow((atanh(least(greatest(CAST(embedding[1] AS DOUBLE), -0.999999), 0.999999)) - CAST(embedding[2] AS DOUBLE)) / exp(0.1), 2) + 0.2 + ln(2 * pi())) + ln(1 - pow(least(greatest(CAST(embedding[1] AS DOUBLE), -0.999999), 0.999999), 2) + 1e-6), 5) AS squashed FROM embeddings""")
def sc33_likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return e.select("vec_id", F.round(A.student_t_nll(a, b, F.lit(0.3), 5.0), 5).alias("student"), F.round(A.squashed_gaussian_nll(a, b, F.lit(0.1)), 5).alias("squashed"))


@query("""SELECT n_nationkey, CAST(n_nationkey * 1024 AS BIGINT) AS total, CAST(n_nationkey AS BIGINT) AS free FROM nation""")
def sc31_meminfo(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    m = T.meminfo(F.concat(F.lit("MemTotal:   "), k, F.lit(" kB\nnoise\nMemFree: "), k, F.lit("\nBad: x kB")))
    return table(spark, sf, "nation").select("n_nationkey", m["MemTotal"].alias("total"), m["MemFree"].alias("free"))
