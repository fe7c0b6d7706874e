import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridelake.llm import token_orc as T
from stridelake.llm._store import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_word_cache_equals_the_library(lib, small):
    rnd = random.Random(5)
    parts = ["a", "é", " ", "\n", "'s", "1", "!", ".", ",", "日", "½", "foo", "x", "\t", " ", "<|endoftext|>", "  "]
    texts = ["".join(rnd.choice(parts[: 13 + 4 * (k % 5 == 0)]) for _ in range(30)) for k in range(1500)]
    tails = ["", ".", "!!", "***", "'", "'s", "...'", "²", "%%%", "_", ")", "\u0301", "-x", "'ll", "#1"]
    texts += [" ".join(rnd.choice(["foo", "BAR", "été", "日本", "7", "2024", "x1", "(a", "'", "½"]) + rnd.choice(tails) for _ in range(12)) for _ in range(1500)]
    texts += [" ".join(t.split()) for t in texts] + [t for _, t in small[:150]]
    cache = T.WordCache(PATH, 300)
    for t in texts * 2:
        assert np.frombuffer(cache.encode(t), "<u4").tolist() == ids(lib, t), repr(t[:80])


def check(lib, rows, got):
    start = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    want = {}
    for d, t in order:
        x = [*ids(lib, t), 0]
        want.setdefault(d, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == [d for d, _ in order]


def test_round_trip(lib, make, small):
    check(lib, small, T.tokens_to_orc(make(small), PATH).collect())


def test_odd_rows(lib, make, odd):
    check(lib, odd, T.tokens_to_orc(make(odd), PATH).collect())
    assert T.tokens_to_orc(make(odd).filter("doc_id > 99"), PATH).collect() == []


def test_files_are_sorted_indexed_and_pruned(spark, make, small):
    path = T.write_tokens(make(small), PATH, new_path(spark, "t"), partitions=4)
    rows = T.read_tokens(spark, path)
    spans = sorted((r.lo, r.hi) for r in rows.selectExpr("input_file_name() f", "doc_id").groupBy("f").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "lo").join(rows.selectExpr("input_file_name() f", "doc_id").groupBy("f").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "hi"), "f").collect())
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    one = rows.filter("doc_id = 17")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1
    import pyarrow.orc as orc
    from pathlib import Path

    files = sorted(Path(path.removeprefix("file:").replace("///", "/")).glob("*.orc"))
    f = orc.ORCFile(files[0])
    assert f.row_index_stride == 1000 and f.compression == "SNAPPY"
    assert b"doc_id" in files[0].read_bytes()[-4000:]


def test_starts_over_many_splits(spark, lib, make, small, monkeypatch):
    """Files of several stripes, read as several splits in one task."""
    monkeypatch.setattr(T, "ORC_OPTIONS", T.ORC_OPTIONS | {"orc.stripe.size": "4096", "orc.compress": "NONE", "orc.stripe.row.count": "1024"})
    rows = [(d + 1000 * i, t) for i in range(4) for d, t in small]
    path = T.write_tokens(make(rows), PATH, new_path(spark, "t"), partitions=2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        splits = T.read_tokens(spark, path).selectExpr("part", "_metadata.file_block_start b").distinct().count()
        check(lib, rows, T.token_index(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 2


def test_the_string_of_an_added_token_is_that_token(lib, make):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>\n y <|endoftext"), (4, "a " * 50 + "<|endoftext|>")]
    assert ids(lib, rows[0][1]) == [64, 220, 50256, 275]
    check(lib, rows, T.tokens_to_orc(make(rows), PATH).collect())


@pytest.mark.parametrize("limit", [1, 10])
def test_starts_over_many_files_of_a_range(spark, lib, make, small, limit):
    rows = small[: 40 * limit]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", limit)
    try:
        path = T.write_tokens(make(rows), PATH, new_path(spark, "t"), partitions=2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert T.read_tokens(spark, path).selectExpr("input_file_name() f").distinct().count() > 15
    check(lib, rows, T.token_index(spark, path).collect())


def test_an_id_of_many_rows_is_dealt_over_files(spark, lib, make):
    rows = [(5 if i % 3 else i, f"text number {i}") for i in range(300)] + [(None, f"n {i}") for i in range(150)]
    path = T.write_tokens(make(rows), PATH, new_path(spark, "t"), partitions=6)
    parts = {r.part: r.n for r in T.read_tokens(spark, path).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert len(parts) >= 5 and max(parts.values()) < 150
    check(lib, rows, T.token_index(spark, path).collect())


def test_many_splits_are_joined_without_a_broadcast(spark, lib, make, small, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_SPLITS", 0)
    check(lib, small, T.tokens_to_orc(make(small), PATH).collect())
