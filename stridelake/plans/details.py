"""Queries: alignment and detection rules, paths, text forms, sinks read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.functions import actions as A
from stridelake.functions import geometry as G
from stridelake.functions import text as T
from stridelake.operators import corpus as C
from stridelake.operators import episodes as E
from stridelake.operators import grid as GR
from stridelake.operators import metrics as M
from stridelake.operators import ordered as O
from stridelake.operators import selection as S
from stridelake.operators import tasks as K
from stridelake.plans.registry import query
from stridelake.sources.tables import GRID_SQL, POSITIONS_SQL, RESULTS_SQL, STEPS_SQL, actions, episode_results, grid, positions, steps, table


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type = 'purchase' END, CASE WHEN event_id % 3 = 1 THEN value > 50 END, false) AS success FROM events""")
def flt1_success_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Success from the first source that has it: a vector, else a list of records, else none."""
    e = table(spark, sf, "events")
    vector = F.when(F.col("event_id") % 3 == 0, F.array(F.col("event_type") == "purchase"))
    records = F.when(F.col("event_id") % 3 == 1, F.array(F.struct((F.col("value") > 50).alias("success"))))
    flags = F.coalesce(vector, F.transform(records, lambda r: F.coalesce(r["success"], F.lit(False))))
    return e.select("event_id", F.coalesce(F.get(flags, F.lit(0)), F.lit(False)).alias("success"))


@query("""SELECT p_partkey, string_agg(CASE WHEN i + CASE WHEN p_size % 6 >= 5 THEN 1 ELSE 0 END < p_size % 6 AND (i + CASE WHEN p_size % 6 >= 5 THEN 1 ELSE 0 END) % 2 = 0 THEN 'T' ELSE 'F' END, '' ORDER BY i) AS aligned
    FROM part, range(4) r(i) GROUP BY p_partkey""")
def flt2_aligned_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event vectors of zero to five values aligned to four transitions."""
    n = (F.col("p_size") % 6).cast("int")
    flags = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % 2 == 0)).otherwise(F.array().cast("array<boolean>"))
    a = E.align_events(flags, F.lit(4))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(a, lambda x: F.when(x, "T").otherwise("F")), "").alias("aligned"))


@query("""WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z, CAST(embedding[2] AS DOUBLE) AS w, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y, CAST(embedding[5] AS DOUBLE) AS k FROM embeddings),
    n AS (SELECT *, sqrt(w * w + x * x + y * y + k * k) AS norm FROM q),
    u AS (SELECT vec_id, z, CASE WHEN vec_id % 2 = 0 THEN norm ELSE 1 END AS norm, CASE WHEN vec_id % 2 = 0 THEN x ELSE x / norm END AS x, CASE WHEN vec_id % 2 = 0 THEN y ELSE y / norm END AS y FROM n)
    SELECT vec_id, CASE WHEN abs(norm - 1) <= 0.001 THEN z < 0.35 AND 1 - 2 * (x * x + y * y) < 0 ELSE z < 0.30 END AS fallen FROM u""")
def flt4_falls(spark: SparkSession, sf: str) -> DataFrame:
    """Falls from height and attitude; every second attitude is made a unit quaternion."""
    e = table(spark, sf, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("zwxyk")))
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyk"), F.col("w") * F.col("w")))
    unit = F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(norm)
    return e.select("vec_id", E.fallen(F.col("z"), [F.col(c) / unit for c in "wxyk"]).alias("fallen"))


@query("""SELECT source, count(*) AS kept FROM documents WHERE n_chars >= 300 GROUP BY source HAVING count(*) >= 1""")
def flt8_row_transform(spark: SparkSession, sf: str) -> DataFrame:
    """A transform that drops rows, with a guard that no selected group loses all of them."""
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    kept = d.filter("n_chars >= 300")
    lost = S.except_keys(d.select("source").distinct(), kept, ["source"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept")).join(lost, "source", "left_anti")


@query("""SELECT vec_id, len(embedding) = 64 AS right_size, len(list_filter(embedding, lambda x: abs(x) <= 1.0001)) = len(embedding) AS in_range FROM embeddings""")
def flt12_value_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.size("embedding") == 64).alias("right_size"), F.forall("embedding", lambda v: F.abs(v) <= F.lit(1.0001).cast("double")).alias("in_range"))


@query(f"""WITH {RESULTS_SQL} SELECT variant, episode_idx, ret FROM results""")
def flt15_score_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Score records without the fields of evaluations; the scan reads what is left only."""
    r = episode_results(spark, sf)
    return r.drop("success", "length", "split", "seed", "step", "family")


@query(f"""WITH {RESULTS_SQL} SELECT step, count(*) AS n FROM results WHERE step <= 1995 GROUP BY step""")
def flt16_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return episode_results(spark, sf).filter("step <= 1995").groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_id % 11 = 0) AS broken FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 11 = 0) > 0""")
def flt17_finite_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values that aren't finite (every eleventh is made so), counted by group."""
    v = F.when(F.col("event_id") % 22 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = table(spark, sf, "events").withColumn("v", v)
    return e.filter(F.isnan("v") | (F.abs("v") == float("inf"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("broken"))


@query(f"""WITH {STEPS_SQL}, e AS (SELECT variant, episode_idx, count(*) AS n, round(sum(reward), 4) AS ret FROM steps GROUP BY ALL)
    SELECT variant, episode_idx, CAST(unnest(range((n - 1) // 20 + 1)) AS INTEGER) AS part, n, ret FROM e""")
def exp3_segment_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes attached to each of their segments of twenty steps."""
    e = steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 4).alias("ret"))
    seg = e.select("variant", "episode_idx", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 20).cast("int"))).alias("part"))
    return seg.join(e, ["variant", "episode_idx"])


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, t, list_sum(list(round(reward, 4)) OVER w)::DOUBLE IS NOT NULL AS has_rest, CAST(count(*) OVER w AS INTEGER) AS rest
    FROM steps WINDOW w AS (PARTITION BY variant, episode_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def wn3_rewards_to_go(spark: SparkSession, sf: str) -> DataFrame:
    """The rewards from each step on; kept as one array for each episode and cut by position, not copied for each step."""
    s = steps(spark, sf)
    whole = s.groupBy("variant", "episode_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "reward"))), lambda x: x["reward"]).alias("rewards"))
    out = whole.select("variant", "episode_idx", F.posexplode("rewards").alias("t", "r"), F.size("rewards").alias("n"))
    return out.select("variant", "episode_idx", F.col("t").cast("long").alias("t"), F.col("r").isNotNull().alias("has_rest"), (F.col("n") - F.col("t")).cast("int").alias("rest"))


_WALK = """m AS (SELECT o_orderkey AS k, i, CAST(substr(sha256(o_orderkey || ':' || i), 1, 1) IN ('0','1','2','3','4','5','6','7') AS INTEGER) AS down FROM orders, range(12) r(i)),
    p AS (SELECT k, i, down, sum(down) OVER w AS row, sum(1 - down) OVER w AS col FROM m WINDOW w AS (PARTITION BY k ORDER BY i))"""


def _walks(spark: SparkSession, sf: str) -> DataFrame:
    """Random walks down and to the right, a row a step."""
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    first = F.substring(F.sha2(F.concat_ws(":", F.col("k").cast("string"), F.col("i").cast("string")), 256), 1, 1)
    m = m.withColumn("down", first.isin(*"01234567").cast("int"))
    w = Window.partitionBy("k").orderBy("i")
    return m.withColumn("row", F.sum("down").over(w)).withColumn("col", F.sum(1 - F.col("down")).over(w))


@query(f"""WITH {_WALK}, d AS (SELECT k, i, abs(row - 6) + abs(col - 2) AS d FROM p)
    SELECT k, CAST(count(*) FILTER (nx > d) AS BIGINT) AS away FROM (SELECT *, lead(d) OVER (PARTITION BY k ORDER BY i) AS nx FROM d) GROUP BY k""")
def wn11_steps_away(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy("i")
    d = _walks(spark, sf).withColumn("d", F.abs(F.col("row") - 6) + F.abs(F.col("col") - 2))
    return d.withColumn("nx", F.lead("d").over(w)).groupBy("k").agg(F.count_if(F.col("nx") > F.col("d")).alias("away"))


@query(f"""WITH {_WALK} SELECT k, CAST(count(*) FILTER (was <> down) AS BIGINT) AS turns FROM (SELECT *, lag(down) OVER (PARTITION BY k ORDER BY i) AS was FROM p) GROUP BY k""")
def wn12_turns(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("k").orderBy("i")
    return _walks(spark, sf).withColumn("was", F.lag("down").over(w)).groupBy("k").agg(F.count_if(F.col("was") != F.col("down")).alias("turns"))


@query()
def tk2_older_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in the order of the older difficulty, with their ranks."""
    h = GR.hard_pairs(GR.pairs(grid(spark, sf), ["map_id", "start_row", "start_col", "goal_row", "goal_col", "path_len", "away_steps"]), 0.0)
    w = Window.partitionBy("map_id").orderBy("hard", "path_len", "away_steps", "start_row", "start_col", "goal_row", "goal_col")
    return h.select("map_id", "start_row", "start_col", "goal_row", "goal_col", F.row_number().over(w).alias("pos"))


@query("""SELECT p_brand, CAST(count(*) AS BIGINT) AS pool, round(min(p_retailprice), 2) AS least FROM (
    SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part) WHERE r <= greatest(1, ceil(c * 0.05)) GROUP BY p_brand""")
def tk4_hard_pool(spark: SparkSession, sf: str) -> DataFrame:
    top = O.top_fraction(table(spark, sf, "part"), ["p_brand"], ["p_retailprice", "p_partkey"], 0.05)
    return top.groupBy("p_brand").agg(F.count(F.lit(1)).alias("pool"), F.round(F.min("p_retailprice"), 2).alias("least"))


@query(f"""WITH {POSITIONS_SQL}, {GRID_SQL}, d AS (SELECT p.pos_id, g.row, g.col, row_number() OVER (PARTITION BY p.pos_id ORDER BY (p.x - (g.col + 0.5 - 5.5)) * (p.x - (g.col + 0.5 - 5.5)) + (p.y - (4.5 - (g.row + 0.5))) * (p.y - (4.5 - (g.row + 0.5))), g.row, g.col) AS n
    FROM positions p JOIN grid g ON g.is_free AND g.map_id = 1) SELECT pos_id, row, col FROM d WHERE n = 1""")
def tk8_nearest_free(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest free cell of every position, ties to the first in row order."""
    all_walls = grid(spark, sf).filter("map_id = 1")
    free = all_walls.filter("is_free").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("free"))
    d = lambda s: (F.col("x") - (s["col"] + 0.5 - 5.5)) ** 2 + (F.col("y") - (4.5 - (s["row"] + 0.5))) ** 2
    best = F.array_min(F.transform("free", lambda s: F.struct(d(s).alias("d"), s["row"].alias("row"), s["col"].alias("col"))))
    return positions(spark, sf).crossJoin(F.broadcast(free.filter(F.size("free") > 0))).select("pos_id", best["row"].alias("row"), best["col"].alias("col"))


@query("""SELECT p_brand, arg_min(p_partkey, struct_pack(a := greatest(0, p_size - 30) + greatest(0, 10 - p_size), b := p_partkey)) AS best FROM part GROUP BY p_brand""")
def tk11_least_penalty(spark: SparkSession, sf: str) -> DataFrame:
    p = T.range_penalty(F.col("p_size"), 10.0, 30.0) * 20
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(p.alias("a"), F.col("p_partkey").alias("b"))).alias("best"))


@query("""SELECT n_name FROM nation WHERE n_name NOT IN ('NATION_7', 'NATION_12')""")
def st6_except_mode(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name")
    names = S.resolve_names("except", ["NATION_7", "NATION_12"], sorted(r.n_name for r in n.collect()))  # a dimension of 25 rows
    return n.filter(F.col("n_name").isin(names))


@query(f"""WITH {RESULTS_SQL} SELECT variant, count(*) AS n, count(*) FILTER (success) AS wins, count(*) >= 50 AND count(*) FILTER (success) / count(*) >= 0.45 AS met FROM results GROUP BY variant""")
def sm18_success_requirement(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if("success")
    return episode_results(spark, sf).groupBy("variant").agg(n.alias("n"), k.alias("wins"), M.success_requirement(n, k, 50, 0.45).alias("met"))


@query(f"""WITH {GRID_SQL} SELECT map_id, count(*) * 16 * 4 AS entries FROM grid GROUP BY map_id""")
def sc5_status_table(spark: SparkSession, sf: str) -> DataFrame:
    return G.status_table(grid(spark, sf), "v3").groupBy("map_id").agg(F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {GRID_SQL} SELECT map_id, row, col, 'at (' || (row + 1) || ',' || (col + 1) || ') goal (8,10) up=free, down=wall, left=risk, right=free' AS line FROM grid WHERE is_free""")
def sc7_sensing_text(spark: SparkSession, sf: str) -> DataFrame:
    line = G.sensing_text(F.col("row"), F.col("col"), F.lit(7), F.lit(9), F.array(*map(F.lit, (0, 1, 2, 0))))
    return grid(spark, sf).filter("is_free").select("map_id", "row", "col", line.alias("line"))


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + 7 + 7 + embedding[4], 5) AS total, CAST(4 AS INTEGER) AS dims FROM embeddings""")
def sc13_restored_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Constant slots taken out of a vector and put back between its ends."""
    e = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    packed, const = F.concat(F.slice("v", 1, 1), F.slice("v", 4, 1)), F.array(F.lit(7.0), F.lit(7.0))
    full = F.concat(F.slice(packed, 1, 1), const, F.slice(packed, 2, 1))
    return e.select("vec_id", F.round(F.aggregate(full, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size(full).alias("dims"))


@query("""WITH l AS (SELECT vec_id, i, CAST(round_even((least(greatest(CAST(embedding[i + 1] AS DOUBLE), -1), 1) + 1) / 2 * 63, 0) AS INTEGER) AS b FROM embeddings, range(4) r(i))
    SELECT vec_id, string_agg(CAST(50000 + 3 * b AS VARCHAR), ',' ORDER BY i) AS ids, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS bins FROM l GROUP BY vec_id""")
def sc16_codec_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Bins to token ids and back through the codec's table."""
    ids = F.array(*(F.lit(50000 + 3 * b) for b in range(64)))
    a = actions(spark, sf, 4).withColumn("b", F.transform("action", lambda v: A.to_bin(v, 64)))
    a = a.withColumn("ids", F.transform("b", lambda b: F.get(ids, b)))
    back = F.filter(F.transform("ids", lambda x: (F.array_position(ids, x) - 1).cast("int")), lambda b: b >= 0)
    return a.select(F.col("episode_idx").alias("vec_id"), F.array_join("ids", ",").alias("ids"), F.array_join(back, ",").alias("bins"))


@query("""SELECT vec_id, 'vx=' || CAST(CAST(floor(embedding[1] * 100) AS INTEGER) AS VARCHAR) || ' x=' || CAST(CAST(floor(embedding[2] * 100) AS INTEGER) AS VARCHAR) AS line FROM embeddings""")
def sc18_observation_text(spark: SparkSession, sf: str) -> DataFrame:
    """Observation text with its tags in a given derangement."""
    tags = T.tag_order(("x", "vx"), ("vx", "x"), True)
    e = table(spark, sf, "embeddings")
    part = lambda i: F.concat(F.lit(f"{tags[i]}="), F.floor(F.col("embedding")[i] * 100).cast("int").cast("string"))
    return e.select("vec_id", F.concat_ws(" ", part(0), part(1)).alias("line"))


@query("""SELECT conv_id, turn, '<user>' || role || '</turn><assistant>' AS asked, '<user>' || role || '</turn><assistant>' || CAST(length(text) AS VARCHAR) || '</turn>' AS trained FROM conversations""")
def sc21_chat_wrapping(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.generation_prompt(F.col("role")).alias("asked"), T.training_chat(F.col("role"), F.length("text").cast("string")).alias("trained"))


@query("""SELECT p_partkey, string_agg(CAST(3 + i // 2 * 2 - 1 AS INTEGER) || ':' || CAST(3 + i AS INTEGER) || ':' || CAST(i % 2 AS INTEGER) || ':' || CAST(p_size + i AS INTEGER), ' ' ORDER BY i) AS slots FROM part, range(4) r(i) GROUP BY p_partkey""")
def sc23_query_slots(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    ids = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("p_size") + i)
    slots = T.query_slots(F.array(F.lit(1), F.lit(2), F.lit(3)), ids, 2)
    return p.select("p_partkey", F.array_join(F.transform(slots, lambda s: F.concat_ws(":", *(s[c].cast("string") for c in ("anchor", "position", "offset", "target")))), " ").alias("slots"))


@query("""SELECT n_nationkey, '#' || repeat('.', n_regionkey + 1) || 'g#' AS line, CAST(n_regionkey + 2 AS INTEGER) AS goal_col, CAST(n_regionkey + 2 AS INTEGER) AS free FROM nation""")
def sc29_map_text(spark: SparkSession, sf: str) -> DataFrame:
    """A map's text parsed: its goal marker and its free cells."""
    line = F.concat(F.lit("#"), F.repeat(F.lit("."), F.col("n_regionkey") + 1), F.lit("g#"))
    n = table(spark, sf, "nation").withColumn("line", line)
    return n.select("n_nationkey", "line", G.find_marker(F.col("line"), "g")["col"].cast("int").alias("goal_col"), F.size(F.filter(F.flatten(G.parse_map(F.col("line"))), lambda v: v == 0)).alias("free"))


@query("""SELECT p_partkey, least(greatest(CAST(p_size AS DOUBLE) / 40, 0), 1) AS clamped, CAST((p_size + 6) // 7 AS BIGINT) AS groups FROM part""")
def sc30_small_functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.clamp01(F.col("p_size") / 40).alias("clamped"), T.ceil_div(F.col("p_size"), 7).alias("groups"))


@query()
def gr15_map_report(spark: SparkSession, sf: str) -> DataFrame:
    """The inspection table of maps: a line of its figures for each."""
    m = GR.map_metrics(grid(spark, sf))
    return m.select("map_id", F.concat_ws(" ", F.concat(F.lit("map-"), F.col("map_id").cast("string")), *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("rows", "cols", "free", "path_len", "deadends", "static_difficulty"))).alias("line"))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) + (SELECT max(c_custkey) FROM customer) AS episode_index, o_orderkey FROM orders""")
def snk2_guarded_append(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a shard appended behind existing indexes, after a check that their keys are new."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode_index"), (-F.col("c_custkey") - 1).alias("o_orderkey"))
    new = table(spark, sf, "orders").select("o_orderkey")
    return C.append_rows(old, new, ["o_orderkey"], "episode_index", ["o_orderkey"]).select("episode_index", "o_orderkey")


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, string_agg(t || chr(9) || CASE WHEN success THEN 'win' ELSE 'go' END, chr(10) ORDER BY t) AS log FROM steps GROUP BY ALL""")
def snk9_step_log(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws("\t", F.col("t").cast("string"), F.when(F.col("success"), "win").otherwise("go"))
    s = steps(spark, sf).select("variant", "episode_idx", F.struct("t", line.alias("line")).alias("s"))
    return s.groupBy("variant", "episode_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("log"))


@query(f"""WITH {RESULTS_SQL} SELECT variant, '{{"variant":"' || variant || '","episodes":' || count(*) || ',"successes":' || count(*) FILTER (success) || '}}' AS payload FROM results GROUP BY variant""")
def snk10_result_json(spark: SparkSession, sf: str) -> DataFrame:
    g = episode_results(spark, sf).groupBy("variant").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("success").alias("successes"))
    return g.select("variant", F.to_json(F.struct("variant", "episodes", "successes")).alias("payload"))


@query(f"""WITH {RESULTS_SQL} SELECT family, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM results GROUP BY family""")
def snk11_report_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The pivot behind a report table."""
    p = episode_results(spark, sf).groupBy("family").pivot("split", ["train", "test"]).agg(F.count(F.lit(1)))
    return p.select("family", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("train", "test")))


@query("""SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id""")
def stm3_latest_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregation that a stream keeps up to date, over the whole log as a batch."""
    from stridelake.streaming.logs import latest

    return latest(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'v3' ELSE 'v' || (p_partkey % 5 + 1) END AS version,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(0.1 AS DOUBLE) ELSE p_size / 100.0::DOUBLE END AS threshold FROM part""")
def sc8_sensing_config(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of sensing as they are written by hand, resolved to one form with defaults."""
    p = table(spark, sf, "part")
    given = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit(" V"), (F.col("p_partkey") % 5 + 1).cast("string"), F.lit(" ")))
    risk = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 100.0)
    return p.select("p_partkey", G.sensing_version(given).alias("version"), G.risk_threshold(risk).alias("threshold"))


@query(f"""WITH {RESULTS_SQL} SELECT episode_idx AS index,
    CASE WHEN episode_idx % 11 = 0 THEN 3 WHEN episode_idx % 3 = 0 THEN 2 ELSE 1 END AS attempts, episode_idx % 11 <> 0 AS completed,
    CASE WHEN episode_idx % 11 = 0 THEN 0.0 ELSE ret END AS ret FROM results""")
def stm1_task_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes as tasks: every third fails its first attempt, every eleventh all three."""

    def work(row: dict, attempt: int) -> float:
        if row["episode_idx"] % 11 == 0 or (row["episode_idx"] % 3 == 0 and attempt == 0):
            raise RuntimeError("worker lost")
        return row["ret"]

    return K.run_tasks(episode_results(spark, sf).select("episode_idx", "ret"), work, "episode_idx").select("index", "attempts", "completed", "ret")


@query("""SELECT event_id, value * 2 + 1 AS response, true AS small FROM events""")
def stm2_answered_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests answered by a policy in batches of up to 64."""
    out = K.answer_in_batches(table(spark, sf, "events").select("event_id", "value"), lambda part: part["value"] * 2 + 1, "event_id")
    return out.select("event_id", "response", (F.col("batch_size") <= 64).alias("small"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS reports, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY user_id""")
def stm4_latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The latest state of each worker; what a monitor shows."""
    return K.snapshots(table(spark, sf, "events"), "user_id", ["event_id"], "event_type", "purchase")
