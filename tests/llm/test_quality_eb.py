import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stridelake.llm import _text as X
from stridelake.llm import quality_eb as Q


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, host string")


def test_held_out_accuracy():
    rows = duckdb.connect().sql("select text, quality from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by doc_id").fetchall()
    x = np.concatenate([Q.features(*X.buffers(pa.array([t for t, _ in rows[i : i + 200]]))) for i in range(0, len(rows), 200)])
    y = np.array([float(q) for _, q in rows])
    m = Q.fit(x[::2], y[::2])
    p = 1 / (1 + np.exp(-Q.logits(m, x[1::2])))
    good, bad = p[y[1::2] == 1], p[y[1::2] == 0]
    assert (good >= Q.THRESHOLD).mean() > 0.995
    assert (bad < Q.THRESHOLD).mean() > 0.95


def test_features_by_hand():
    x = Q.features(*X.buffers(pa.array(["ab AB 12|", "", "go go go\ngo"])))
    names = dict(zip(Q.NAMES, x[0], strict=False))
    assert [round(names[k], 6) for k in ("lower", "upper", "digit", "space", "bar")] == [round(v / 9, 6) for v in (2, 2, 2, 2, 1)]
    assert not x[1].any()
    third = dict(zip(Q.NAMES, x[2], strict=False))
    assert (third["distinct"], third["top_word"], third["echo"]) == (0.25, 1.0, 0.75)


def sites(spark):
    """Texts that all look alike, at hosts that differ in their share of labels."""
    rnd = random.Random(1)
    docs, marks = [], []
    for h, share in enumerate([0.95] * 10 + [0.05] * 10):
        for i in range(30):
            d = h * 100 + i
            good = rnd.random() < share
            docs.append((d, " ".join(rnd.choice(["alpha", "beta"] if good else ["###", "!!!", "alpha"]) for _ in range(4)), f"en{i % 2}", f"host{h}"))
            marks.append((d, int(good), 0, None, None))
    docs.append((9999, "alpha ###", "en0", "host0"))
    docs.append((9998, "alpha ###", "en0", "host19"))
    docs.append((9997, "alpha ###", "en0", "lonely"))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), labels(spark, marks)


def test_posteriors_shrink_and_move_documents(spark):
    docs, marks = sites(spark)
    got = {r.doc_id: r for r in Q.score(docs, marks).collect()}
    assert len(got) == 603
    hosts = {r.host: r.p_host for r in got.values()}
    shares = {}
    for r in got.values():
        shares.setdefault(r.host, []).append(r.p_doc)
    base = np.mean([p for v in shares.values() for p in v])
    for h, v in shares.items():
        assert min(np.mean(v), base) - 1e-9 <= hosts[h] <= max(np.mean(v), base) + 1e-9
    assert abs(hosts["lonely"] - base) < abs(np.mean(shares["lonely"]) - base)
    assert got[9999].p_doc == got[9998].p_doc
    assert got[9999].p_quality > got[9997].p_quality > got[9998].p_quality


def strength(groups, total):
    """Prior weight by the method of moments, over (sum, count, mean) of groups."""
    between = sum(n * (s / n - m) ** 2 for s, n, m in groups)
    chance = sum(m * (1 - m) for _, _, m in groups)
    unit = sum(m * (1 - m) * n for _, n, m in groups)
    rho = (between - chance) / max(unit - chance, 1e-12)
    return min(Q.STRONGEST, max(1.0, 1 / rho - 1)) if rho > 1 / Q.STRONGEST else Q.STRONGEST


def posteriors(rows):
    """{doc_id: p_quality}, document by document, from their own evidence and that of all others."""
    total, n = sum(r.p_doc for r in rows), len(rows)
    base = total / n
    group = lambda key: {k: [x for x in rows if key(x) == k] for k in {key(r) for r in rows}}
    hosts, paths = group(lambda r: r.host), group(lambda r: (r.host, r.path))
    k_host = strength([(sum(r.p_doc for r in v), len(v), base) for v in hosts.values()], n)
    mean = {h: (k_host * base + sum(r.p_doc for r in v)) / (k_host + len(v)) for h, v in hosts.items()}
    k_path = strength([(sum(r.p_doc for r in v), len(v), mean[h]) for (h, _), v in paths.items()], n)
    odds = lambda p: np.log(p / (1 - p))
    out = {}
    for r in rows:
        b = (total - r.p_doc) / (n - 1)
        others = [x.p_doc for x in hosts[r.host] if x is not r]
        h = (k_host * b + sum(others)) / (k_host + len(others))
        near = [x.p_doc for x in paths[r.host, r.path] if x is not r]
        p = (k_path * h + sum(near)) / (k_path + len(near))
        out[r.doc_id] = 1 / (1 + np.exp(-(odds(r.p_doc) + odds(p) - odds(b))))
    return out


def test_against_a_plain_twin(spark):
    docs, marks = sites(spark)
    rows = Q.score(docs, marks).collect()
    want = posteriors(rows)
    assert all(abs(r.p_quality - want[r.doc_id]) < 1e-6 for r in rows)
    assert all(r.kept == (r.p_quality >= Q.THRESHOLD) for r in rows)


def test_a_site_of_one_document_adds_nothing_of_its_own(spark):
    docs, marks = sites(spark)
    got = {r.doc_id: r for r in Q.score(docs, marks).collect()}
    assert got[9997].host == "lonely" and abs(got[9997].p_quality - got[9997].p_doc) < 1e-6


def test_alike_sites_change_nothing(spark, make):
    rnd = random.Random(2)
    rows = [(i, "good words here and more " * rnd.randrange(1, 4) if i % 5 else "### !! ## " * rnd.randrange(1, 4)) for i in range(200)]
    docs = make(rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") / 10 % 4).cast("int").cast("string")))
    got = Q.score(docs, labels(spark, [(i, int(i % 5 > 0), 0, None, None) for i in range(200)])).collect()
    assert all(abs(r.p_quality - r.p_doc) < 0.05 for r in got)
    assert {r.doc_id for r in got if not r.kept} == {i for i in range(0, 200, 5)}


def test_odd_rows(spark, make, odd):
    marks = labels(spark, [(1, 1, 0, None, None), (1, 0, 0, None, None), (3, None, 0, None, None), (None, 1, 0, None, None), (6, 1, 0, None, None), (555, 0, 1, None, None)])
    got = Q.score(make(odd, None, None), marks).collect()
    assert len(got) == len(odd) and all(r.p_quality is not None for r in got)
    for m in (marks.filter("doc_id > 99"), marks.filter("quality = 1")):
        assert all(r.kept for r in Q.score(make(odd), m).collect())
    assert Q.score(make(odd).filter("doc_id > 99"), marks).collect() == []
