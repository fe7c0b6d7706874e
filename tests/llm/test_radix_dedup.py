import random

import pytest

from stridelake.llm import radix_dedup as R
from tests.llm.brute import digest


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real) if real else None
        out += [(d, keep, len(ids), d == keep, digest(t)) for d in ids]
    return sorted(out, key=str)


def run(frame):
    return sorted(map(tuple, R.radix_dedup(frame).collect()), key=str)


@pytest.mark.parametrize("first,growth,longest", [(1, 1, 1), (2, 3, 9), (64, 64, 1 << 20)])
def test_any_digits_give_the_same_groups(make, monkeypatch, first, growth, longest):
    monkeypatch.setattr(R, "FIRST_DIGIT", first)
    monkeypatch.setattr(R, "GROWTH", growth)
    monkeypatch.setattr(R, "LONGEST_DIGIT", longest)
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ab日") for _ in range(rnd.randrange(7)))) for i in range(150)]
    assert run(make(rows)) == expected(rows)


def test_long_shared_heads(make):
    head = "h" * 5000
    rows = [(i, head + "x" * (i % 3) + str(i % 2)) for i in range(30)] + [(40, "z" * 400000), (41, "z" * 400000), (42, "z" * 399999 + "y")]
    assert run(make(rows)) == expected(rows)


def test_odd_rows(make, odd):
    assert run(make(odd)) == expected(odd)
    twice = odd + [(3, "one"), (3, "two"), (9, "two")]
    assert run(make(twice)) == expected(twice)
    assert run(make(odd).filter("doc_id > 99")) == []


def test_small_table(make, small):
    assert run(make(small)) == expected(small)
