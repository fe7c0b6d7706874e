import random

import numpy as np
import pyarrow as pa
import pytest

from stridelake.llm import _text as X
from stridelake.llm import chosen_path as C
from tests.llm import brute


def edit(rnd, words, n):
    out = list(words)
    for _ in range(n):
        i = rnd.randrange(len(out))
        out[i] = f"e{rnd.randrange(10**6)}"
    return out


def planted(seed, groups=25, members=6, length=120):
    rnd = random.Random(seed)
    rows, d = [], 0
    for g in range(groups):
        base = [f"g{g}w{i}" if rnd.random() < 0.9 else "the" for i in range(rnd.randrange(3, length))]
        for _ in range(rnd.randrange(1, members)):
            rows.append((d, " ".join(edit(rnd, base, rnd.randrange(5)))))
            d += 1
    rnd.shuffle(rows)
    return rows


def run(frame, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in C.near_duplicates(frame, **kw).collect()}


@pytest.mark.parametrize("k,pct", [(4, 80), (5, 80), (2, 60)])
def test_against_all_pairs(make, k, pct):
    rows = planted(k * pct)
    want = brute.near(rows, k, pct)
    assert run(make(rows), k=k, similarity_pct=pct) == want
    assert 0 < sum(v[1] != d for d, v in want.items()) < len(rows)


@pytest.mark.parametrize("depth,shingles,dense", [(4, 1 << 19, 2), (0, 300, 0), (1, 60, 10**9)])
def test_a_large_group_in_small_nodes(make, monkeypatch, depth, shingles, dense):
    """A group whose members are near a few others only: leaders don't link it; nodes branch, end in groups, and are dense or not."""
    monkeypatch.setattr(C, "LEAF", 8)
    monkeypatch.setattr(C, "DEPTH", depth)
    monkeypatch.setattr(C, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(C, "DENSE", dense)
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edit(rnd, base, rnd.randrange(9)))) for i in range(150)] + [(200 + i, " ".join(f"o{i}x{j}" for j in range(30))) for i in range(20)]
    want = brute.near(rows)
    assert len({v[1] for v in want.values()}) > 22
    assert run(make(rows)) == want
    monkeypatch.setattr(C, "BROADCAST_ENDS", 0)
    assert run(make(rows[:60])) == brute.near(rows[:60])


def test_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(C, "BLOCK_SHINGLES", 20)
    n = np.array([3, 4, 5, 30, 1, 9, 1])
    groups = C._groups(n)
    assert np.concatenate(groups).tolist() == list(range(7))
    assert all(n[g].sum() <= 10 or len(g) == 1 for g in groups)


def test_a_chain_of_links(make):
    words = [f"w{i}" for i in range(60)]
    rows = [(30 - s, " ".join(words[s : s + 40])) for s in range(20)]
    want = brute.near(rows)
    assert run(make(rows)) == want
    assert {v[1] for v in want.values()} == {11}


def test_odd_rows(make, odd):
    rows = odd + [(3, "one"), (20, "ONE"), (21, "one two"), (22, "One Two")]
    got = C.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fp): r for r in got}
    assert sorted({r.component_id for r in got if r.doc_id in (3, 4, 20, -5)}) == [-5]
    assert [r.component_id for r in got if r.doc_id in (21, 22)] == [21, 21]
    assert all((r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True) for r in got if r.doc_id in (1, 2, 5))
    assert sorted((r.n_shingles, r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(0, True, True), (1, False, False)]
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert len(by) == len(rows) - 1
    assert C.near_duplicates(make(rows).filter("doc_id > 99")).collect() == []


def test_only_null_ids(make):
    got = C.near_duplicates(make([(None, "a b c d e"), (None, "a b c d e")])).collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 2


def test_ids_that_repeat_with_other_texts(make):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in C.near_duplicates(make([(1, "a b c d e f"), (1, "x y z u v w q"), (0, "x y z u v w q")])).collect()}
    assert got == {(1, 3): 1, (1, 4): 0, (0, 4): 0}


def test_sets_equal_plain_sets(small):
    texts = [t for _, t in small[:60]] + ["", "one", "One two", "a b c"]
    s, b = C.shingle_sets(*X.buffers(pa.array(texts)), 4)
    assert list(np.diff(b)) == [len(brute.shingles(t, 4)) for t in texts]


def test_a_pair_at_the_threshold_meets_in_a_tree():
    """Share of pairs of similarity 0.8 that end in a common node, over simulated tokens."""
    rng = np.random.default_rng(1)
    n = 3000
    a = rng.integers(0, 1 << 32, (n, C.COORDS), dtype=np.uint64).astype(np.uint32)
    b = np.where(rng.random((n, C.COORDS)) < 0.8, a, rng.integers(0, 1 << 32, (n, C.COORDS), dtype=np.uint64).astype(np.uint32))
    met = np.zeros(n, bool)
    for tree in range(C.TREES):
        pa_, pb = (np.full(n, C.X.mix(np.array([tree + 1], np.uint64))[0], np.uint64) for _ in range(2))
        ra = rb = np.arange(n)
        for level in range(4):
            ia, pa_ = C._children(pa_, a[ra], level)
            ib, pb = C._children(pb, b[rb], level)
            ra, rb = ra[ia], rb[ib]
        same = set(zip(ra.tolist(), pa_.tolist(), strict=True)) & set(zip(rb.tolist(), pb.tolist(), strict=True))
        met[[i for i, _ in same]] = True
    assert met.mean() > 0.999


def test_small_table(make, small):
    assert run(make(small)) == brute.near(small)


def moved(spark):
    """Bytes written for shuffles so far."""
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("ends", [C.BROADCAST_ENDS, 0])
def test_texts_in_no_pair_do_not_move(spark, make, monkeypatch, ends):
    monkeypatch.setattr(C, "BROADCAST_ENDS", ends)
    rnd = random.Random(8)
    rows = [(i, " ".join(f"{rnd.getrandbits(64):x}" for _ in range(2000))) for i in range(40)]
    rows.append((40, rows[7][1] + " more"))
    docs = make(rows).coalesce(1).localCheckpoint()
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if not ends else ()  # as for more ends than the test has
    for name in settings:
        spark.conf.set(name, "-1")
    try:
        before = moved(spark)
        assert run(docs) == {d: (1997, d) for d in range(40)} | {40: (1998, 7)}
        assert moved(spark) - before < sum(len(t) for _, t in rows) / 2
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_sketches_pass_what_tokens_pass():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 32, (200, C.COORDS), dtype=np.uint64).astype("<u4")
    b = np.where(rng.random(a.shape) < rng.random((200, 1)), a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint64).astype("<u4"))
    blobs = [r.view(np.uint8).reshape(C.COORDS, 4).T.tobytes() for r in a]
    assert (C._tokens(pa.array(blobs, pa.binary())) == a).all()
    assert all(x[: C.COORDS] == (r & 0xFF).astype(np.uint8).tobytes() for x, r in zip(blobs, a, strict=True))
    (ax, ay), (bx, by) = C._sketch(a), C._sketch(b)
    agree = np.array([C.COORDS - bin(int(x) & (1 << 64) - 1).count("1") for x in (ax ^ bx) | (ay ^ by)])
    assert (agree == ((a & 3) == (b & 3)).sum(axis=1)).all()
    assert (agree >= (a == b).sum(axis=1)).all()
