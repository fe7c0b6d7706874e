"""Queries: scans, filters, truncation, unnesting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.operators import corpus as C
from stridelake.operators import episodes as E
from stridelake.operators import selection as S
from stridelake.plans.registry import query
from stridelake.sources.tables import STEPS_SQL, actions, steps, table

_HOLD = 2


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, count(*) AS n_steps, round(sum(reward), 4) AS ret FROM steps GROUP BY ALL""")
def src1_variant_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.sum("reward"), 4).alias("ret"))


@query("""SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def src6_selected_scan(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return S.select_keys(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), keys, ["doc_id"])


@query("""SELECT source, 'steps' || CAST(CAST(sum(n_chars) AS BIGINT) AS VARCHAR) AS signature FROM documents GROUP BY source""")
def src9_size_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.concat(F.lit("steps"), F.sum("n_chars").cast("string")).alias("signature"))


@query("""SELECT user_id, event_id, event_type FROM (
    SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 3""")
def src15_nth_record(spark: SparkSession, sf: str) -> DataFrame:
    return S.nth(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "event_type")


@query("""SELECT doc_id, 'unlabelled' AS finding FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def snk4_repair_findings(spark: SparkSession, sf: str) -> DataFrame:
    return C.repair_findings(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "unlabelled", "missing")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    SELECT l_orderkey, l_linenumber, n FROM c""")
def snk5_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH b AS (SELECT source, doc_id // 1000 AS bucket, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), chr(10) ORDER BY doc_id)) AS h
    FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS content_hash FROM b GROUP BY source""")
def snk6_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return C.content_hash(d, "source", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")))


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, t FROM steps s WHERE EXISTS (
    SELECT 1 FROM steps w WHERE w.variant = s.variant AND w.episode_idx = s.episode_idx AND w.success)""")
def flt3_successful_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return E.keep_successful(steps(spark, sf)).select("variant", "episode_idx", "t")


_CUT = """cut AS (SELECT s.*, b.last_t, least(b.last_t, coalesce(b.first_t + {hold}, b.last_t)) AS end_t FROM {src} s JOIN (
    SELECT variant, episode_idx, max(t) AS last_t, min(t) FILTER ({event}) AS first_t FROM {src} GROUP BY ALL) b USING (variant, episode_idx))"""


@query(f"""WITH {STEPS_SQL}, {_CUT.format(src="steps", event="success", hold=_HOLD)}
    SELECT variant, episode_idx, t, t = end_t AND end_t < last_t AS truncated FROM cut WHERE t <= end_t""")
def flt5_truncate_at_success(spark: SparkSession, sf: str) -> DataFrame:
    return E.truncate_at_event(steps(spark, sf), F.col("success"), _HOLD).select("variant", "episode_idx", "t", "truncated")


@query(f"""WITH {STEPS_SQL}, {_CUT.format(src="steps", event="success OR fall", hold=0)}
    SELECT variant, episode_idx, count(*) AS n_steps, bool_or(success) AS won FROM cut WHERE t <= end_t GROUP BY ALL""")
def flt6_truncate_at_event(spark: SparkSession, sf: str) -> DataFrame:
    cut = E.truncate_at_event(steps(spark, sf), F.col("success") | F.col("fall"))
    return cut.groupBy("variant", "episode_idx").agg(F.count(F.lit(1)).alias("n_steps"), F.bool_or("success").alias("won"))


@query(f"""WITH {STEPS_SQL}, won AS (SELECT * FROM steps WHERE (variant, episode_idx) IN (SELECT (variant, episode_idx) FROM steps WHERE success)),
    {_CUT.format(src="won", event="success OR fall", hold=0)}, short AS (SELECT * FROM cut WHERE t <= end_t)
    SELECT variant, episode_idx, t, reward FROM short WHERE (variant, episode_idx) IN (SELECT (variant, episode_idx) FROM short WHERE success)""")
def flt7_filter_truncate_refilter(spark: SparkSession, sf: str) -> DataFrame:
    return E.filter_truncate_refilter(steps(spark, sf)).select("variant", "episode_idx", "t", "reward")


_RANGES = [(0, 100), (250, 400), (900, 1200)]


@query("""SELECT doc_id, CASE WHEN doc_id < 100 THEN 0 WHEN doc_id < 400 THEN 250 ELSE 900 END AS range_start FROM documents
    WHERE doc_id < 100 OR (doc_id >= 250 AND doc_id < 400) OR (doc_id >= 900 AND doc_id < 1200)""")
def flt9_seed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return S.in_ranges(table(spark, sf, "documents").select("doc_id"), "doc_id", S.normalize_ranges(_RANGES, 0, 10**12))


@query("""SELECT n_name, 'except' AS mode FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)""")
def flt10_except_selection(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return S.except_keys(n.select("n_name"), n.filter("n_nationkey % 5 = 0").select("n_name"), ["n_name"]).withColumn("mode", F.lit("except"))


@query(f"""WITH {STEPS_SQL} SELECT variant, episode_idx, t FROM (
    SELECT *, row_number() OVER (PARTITION BY variant ORDER BY episode_idx, t) AS n FROM steps) WHERE n <= 50""")
def flt11_sample_cap(spark: SparkSession, sf: str) -> DataFrame:
    return S.cap(steps(spark, sf), ["variant"], ["episode_idx", "t"], 50).select("variant", "episode_idx", "t")


@query(f"""WITH {STEPS_SQL}, f AS (SELECT *, success AS terminated, reward > 90 AS truncated, lead(t) OVER (PARTITION BY variant, episode_idx ORDER BY t) AS later FROM steps)
    SELECT variant, episode_idx, 'terminated before the end' AS rule, count(*) AS n FROM f WHERE terminated AND later IS NOT NULL GROUP BY ALL
    UNION ALL SELECT variant, episode_idx, 'terminated and truncated', count(*) FROM f WHERE terminated AND truncated GROUP BY ALL""")
def flt13_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = steps(spark, sf).withColumn("terminated", F.col("success")).withColumn("truncated", F.col("reward") > 90)
    return E.violations(s)


@query("""WITH v AS (SELECT label, list_concat(embedding[1:2], [CAST(label AS FLOAT), CAST(1.5 AS FLOAT)]) AS x FROM embeddings),
    l AS (SELECT label, unnest(range(4)) AS slot, unnest(x) AS v FROM v)
    SELECT CAST(label AS BIGINT) AS variant, CAST(slot AS INTEGER) AS slot, CAST(min(v) AS DOUBLE) AS value FROM l GROUP BY label, slot HAVING min(v) = max(v)""")
def flt14_constant_slots(spark: SparkSession, sf: str) -> DataFrame:
    a = actions(spark, sf, 2)
    packed = a.select("variant", F.concat("action", F.array(F.col("variant").cast("float"), F.lit(1.5).cast("float"))).alias("x"))
    return E.constant_slots(packed, "x", "variant").withColumn("value", F.col("value").cast("double"))


@query(f"""WITH {STEPS_SQL}, tpl AS (SELECT * FROM (VALUES (0, 'plain'), (1, 'map'), (2, 'sensing')) v(ord, template))
    SELECT variant, episode_idx, t, template, t * 3 + ord AS sample FROM steps, tpl""")
def exp1_step_templates(spark: SparkSession, sf: str) -> DataFrame:
    tpl = spark.createDataFrame([(0, "plain"), (1, "map"), (2, "sensing")], "ord long, template string")
    out = E.explode_prompts(steps(spark, sf), tpl)
    return out.select("variant", "episode_idx", "t", "template", (F.col("t") * 3 + F.col("ord")).alias("sample"))


@query(f"""WITH {STEPS_SQL}, h AS (SELECT *, lag(reward, 1) OVER (PARTITION BY variant, episode_idx ORDER BY t) AS before FROM steps)
    SELECT variant, episode_idx, t, round(before, 4) AS before FROM h WHERE t >= 4 AND t < 9""")
def exp2_segment_with_history(spark: SparkSession, sf: str) -> DataFrame:
    s = steps(spark, sf)
    w = Window.partitionBy("variant", "episode_idx").orderBy("t")
    seg = s.select("variant", "episode_idx").distinct().select("*", F.lit(4).alias("start_t"), F.lit(9).alias("end_t"))
    cut = E.in_segments(s.withColumn("before", F.lag("reward").over(w)), seg)
    return cut.select("variant", "episode_idx", "t", F.round("before", 4).alias("before"))


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_labels FROM labels GROUP BY doc_id
    UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def st1_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id")
    n = lab.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_labels"))
    return S.union_distinct(table(spark, sf, "documents").select("doc_id"), lab).join(n, "doc_id", "left").select("doc_id", F.coalesce("n_labels", F.lit(0).cast("long")).alias("n_labels"))


@query("""SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def st2_difference(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.except_keys(table(spark, sf, "orders").select("o_custkey").distinct(), b, ["o_custkey"])


@query("""SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer""")
def st3_intersection(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return s.intersect(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")))


@query("""SELECT NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS is_subset,
    NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AS is_equal""")
def st4_subset_equality(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return S.compare_sets(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))


@query("""SELECT k, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY k""")
def st5_bag_union(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return s.unionByName(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM x GROUP BY user_id""")
def st7_ordered_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return S.ordered_distinct(e, ["user_id"], "event_type", "event_id").select("user_id", F.array_join("kept", ",").alias("kinds"))
