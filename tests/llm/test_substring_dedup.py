import random

import numpy as np
import pyarrow as pa
import pytest

from stridelake.llm import _text as X
from stridelake.llm import substring_dedup as S
from tests.llm import brute


def run(frame, **kw):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeats(frame, **kw).collect()]


def planted(n, seed=0, words=40):
    rnd = random.Random(seed)
    shared = [" ".join(f"s{j}{i}" for i in range(30)) for j in range(4)]
    out = []
    for d in range(n):
        body = [f"w{rnd.randrange(words)}" for _ in range(rnd.randrange(0, 90))]
        at = rnd.randrange(len(body) + 1)
        if rnd.random() < 0.6:
            body[at:at] = rnd.choice(shared).split()[rnd.randrange(8) :]
        if rnd.random() < 0.2:
            body += body
        out.append((d, " ".join(body)))
    return out


@pytest.mark.parametrize("k", [3, 8, 20])
def test_against_brute_force(make, k):
    rows = planted(150)
    want = brute.repeats(rows, k)
    assert {d: tuple(x) for d, *x in run(make(rows), k=k)} == want
    assert any(v[1] for v in want.values())


def test_a_tiny_sketch_loses_nothing(make):
    rows = planted(80, 1)
    assert {d: tuple(x) for d, *x in run(make(rows), max_cells=1 << 10)} == brute.repeats(rows)


def test_short_periods_inside_one_document(make):
    rows = [(1, "a b " * 40), (2, "a b c " * 20), (3, "q " * 19), (4, "q " * 20), (5, "q " * 21)]
    assert {d: tuple(x) for d, *x in run(make(rows))} == brute.repeats(rows)


def test_blocks_that_cut_a_group(make, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)
    monkeypatch.setattr(S, "BLOCK_GROUP", 50)
    rows = planted(100, 2)
    assert {d: tuple(x) for d, *x in run(make(rows))} == brute.repeats(rows)


def test_odd_rows(make, odd):
    got = run(make(odd))
    assert len(got) == len(odd)
    want = brute.repeats([r for r in odd if r[0] is not None])
    assert {d: tuple(x) for d, *x in got if d is not None} == want
    assert sorted(x[3] for x in got if x[0] is None) == ["", "one"]


def test_null_ids_come_last(make):
    text = " ".join(f"v{i}" for i in range(25))
    got = run(make([(None, text), (5, text)]))
    assert sorted((d is None, n) for d, _, n, _ in got) == [(False, 0), (True, 25)]


def test_repeated_rows_are_one_document(make):
    text = " ".join(f"v{i}" for i in range(25))
    assert [x[2] for x in run(make([(5, text), (5, text)]))] == [0, 0]
    other = text + " more"
    assert sorted(x[2] for x in run(make([(5, text), (5, other)]))) in ([0, 25], [0, 25])


def test_empty_table(make, spark):
    assert run(make([(1, "x")]).filter("doc_id > 5")) == []


def test_word_hashes(small):
    texts = [t for _, t in small[:40]]
    raw, offsets = X.buffers(pa.array([*texts, None, "", "tail"]))
    starts, ends, h, first = X.words(raw, offsets)
    seen = {}
    for w, v in zip((bytes(raw[a:z]) for a, z in zip(starts, ends, strict=True)), h, strict=True):
        assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)
    assert [int(x) for x in np.diff(first)][-3:] == [0, 0, 1]
    assert list(np.diff(first)[:40]) == [len(brute.WORD.findall(t)) for t in texts]


def test_words_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 16)
    raw, offsets = X.buffers(pa.array(["ab " * 20 + "c" * 100 + " ab", "c" * 100]))
    _, _, h, first = X.words(raw, offsets)
    assert h[0] == h[19] == h[21] and h[20] == h[22] and len(set(h.tolist())) == 2
    r, p, w = X.windows(h, first, 3)
    assert len(w) == 20 and len(set(w.tolist())) == 3
