import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from stridelake.llm import _store, chosen_path, mixing, quality_eb
from stridelake.llm.queries import MIX_WEIGHTS
from tests.llm import brute
from tests.llm.test_decontaminate import plain
from tests.llm.test_mixing import allocate
from tests.llm.test_quality_eb import posteriors

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for i, (name, f) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_order_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]
    want = spark.read.parquet(f"{D}/documents.parquet").columns
    assert all(df.columns == want for _, df in stages[:-1])


def test_junk_goes_and_clean_documents_stay(stages):
    marks = dict(duckdb.connect().sql(f"select doc_id, quality from '{D}/labels.parquet'").fetchall())
    kept = set(ids(stages[0][1]))
    good = [d for d, q in marks.items() if q == 1]
    bad = [d for d, q in marks.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.995 * len(good)
    assert sum(d not in kept for d in bad) >= 0.95 * len(bad)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[0][1].select("doc_id", "text").collect()]
    want = {d for d, (_, c) in brute.near(rows, 5, 80).items() if c == d}
    assert set(ids(stages[1][1])) == want


def test_test_items_go(stages):
    items = [t for (t,) in duckdb.connect().sql(f"select text from '{D}/benchmark.parquet'").fetchall()]
    before = stages[1][1].select("doc_id", "text").collect()
    assert set(ids(stages[2][1])) == {r.doc_id for r in before if not any(t in r.text for t in items)}


def test_quality_stage_against_its_plain_twin(spark, stages):
    scored = quality_eb.score(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")).collect()
    want = posteriors(scored)
    assert set(ids(stages[0][1])) == {d for d, p in want.items() if p >= quality_eb.THRESHOLD}
    assert 0 < len(set(ids(stages[0][1]))) < len(want)


def test_decontamination_stage_against_plain_scoring(stages):
    items = duckdb.connect().sql(f"select item_id, text from '{D}/benchmark.parquet'").fetchall()
    before = [(r.doc_id, r.text) for r in stages[1][1].select("doc_id", "text").collect()]
    near = [(d, t) for d, t in before if d % 4 == 0 or any(x.split("\n")[-1][:20] in (t or "") for _, x in items)]
    gone = {d for d, _ in plain(near, items)}
    assert gone and set(ids(stages[2][1])) & {d for d, _ in near} == {d for d, _ in near} - gone


def test_mixing_stage_against_its_plain_twin(stages):
    rows = stages[2][1].select("doc_id", "text", "lang", "source").collect()
    leaves, members = {}, {}
    for r in rows:
        number = re.search("[0-9]{1,9}$", r.source or "")
        leaf = (f"domain{int(number[0]) % 4}" if number else "domain", r.lang or "", r.source or "")
        n = len(brute.WORD.findall(r.text or ""))
        leaves[leaf] = leaves.get(leaf, 0) + n
        members.setdefault(leaf, []).append((r.doc_id, n))
    given = allocate(leaves, MIX_WEIGHTS, int(0.9 * sum(leaves.values())), 1)
    want = set()
    for leaf, tokens in leaves.items():
        whole = given[leaf] // tokens if tokens else 1
        rest, run = given[leaf] - whole * tokens, 0
        want |= {d for d, _ in members[leaf]} if whole else set()
        for d, n in sorted(members[leaf], key=lambda m: (hashlib.sha256(f"7:{whole}:{m[0]}".encode()).hexdigest()[:15], m[0])) if rest and not whole else []:
            run += n
            if run > rest:
                break
            want.add(d)
    assert set(ids(stages[3][1])) == want


def test_token_stage_against_the_library(stages):
    lib, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    want = []
    for r in sorted(stages[3][1].select("doc_id", "text").collect()):
        x = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[4][1].collect()) == want


def test_mixing_takes_nine_tenths(stages):
    words = [sum(len((t or "").split()) for (t,) in df.select("text").collect()) for _, df in stages[2:4]]
    assert 0.85 * words[0] < words[1] <= 0.9 * words[0]
    assert set(ids(stages[3][1])) < set(ids(stages[2][1]))


def test_every_document_left_is_encoded(stages):
    assert sorted(ids(stages[4][1])) == sorted(ids(stages[3][1]))


def test_odd_documents_pass_every_stage(spark, make, odd):
    docs = make(odd + [(3, "one")], None, None)
    for _, f in C.STAGES[:-1]:
        got = f(spark, docs, D)
        assert got.columns == docs.columns
        assert f(spark, docs.filter("doc_id > 99"), D).collect() == []
        docs = got
    assert {r.doc_id for r in C.token_output(spark, docs, D).collect()} == set(ids(docs))


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, C.run(spark, D).collect())) == sorted(map(tuple, stages[4][1].collect()))


def test_small_tables_have_few_files(spark, monkeypatch, tmp_path):
    """More shuffle partitions than the rows need don't make more files, each of which starts processes."""
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in settings}, {}

    def cut(df, name, parts=None):
        out = _store.cut(df, name, parts)
        files[name] = len(list(Path(out._cut_path.removeprefix("file:")).glob("part-*")))
        return out

    for m in (chosen_path, quality_eb, mixing):
        monkeypatch.setattr(m, "cut", cut)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for i, (_, f) in enumerate(C.STAGES[:-1]):
            f(spark, docs, D).write.parquet(path := str(tmp_path / str(i)))
            files[i] = len(list(Path(path).glob("part-*")))
            docs = spark.read.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    held = {"classes", "stars", "placed", "paths", "leaves", "plan", "edge", 0, 1, 2, 3}
    assert held <= files.keys() and all(files[x] <= 8 for x in held), files
