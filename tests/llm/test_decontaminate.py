import random

import pyarrow as pa
import pytest

from stridelake.llm import decontaminate as D


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, id int, fp int")


ITEMS = [(i, " ".join(f"q{i}x{j}" if j % 3 else "the" for j in range(24)) + ".", None, None) for i in range(30)]


def words(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", f"z{rnd.randrange(500)}"]) for _ in range(n))


def test_whole_items_are_found_wherever_they_stand(spark, make):
    rnd = random.Random(3)
    rows, want = [], set()
    for d in range(60):
        a, b = words(rnd, rnd.randrange(300)), words(rnd, rnd.randrange(300))
        if d % 3 == 0:
            item = rnd.randrange(30)
            rows.append((d, f"{a} {ITEMS[item][1].upper()} {b}"))
            want.add((d, item))
        else:
            rows.append((d, f"{a} {b}"))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(make(rows), bench(spark, ITEMS)).collect()}
    assert got == want
    assert got == {(r.doc_id, r.item_id) for r in D.contaminated(make(rows), bench(spark, ITEMS), shard_bytes=700).collect()}


def test_question_alone_is_no_leak(spark, make):
    w = ITEMS[4][1].split()
    rows = [(1, " ".join(w[:12])), (2, " ".join(w[12:])), (3, " ".join(w)), (4, " ".join(w[12:] + w[:12]))]
    assert {r.doc_id for r in D.contaminated(make(rows), bench(spark, ITEMS)).collect()} == {3, 4}


def test_question_and_answer_lines():
    q, a = D.Index([(1, "what is it?\nsay now\nforty two")]).parts[0]
    assert (len(q), len(a)) == (5, 2)


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6, 0.9])
def test_block_max_wand_equals_full_scoring(threshold, monkeypatch):
    monkeypatch.setattr(D, "POSTINGS", 4)
    rnd = random.Random(7)
    idx = D.Index([(i, " ".join(f"t{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randrange(5, 30)))) for i in range(120)])
    for _ in range(200):
        terms = sorted(rnd.sample(range(len(idx.vocab)), rnd.randrange(1, 30)))
        full = {}
        for t in terms:
            for i, s in zip(idx.items[t], idx.scores[t], strict=True):
                full[i] = full.get(i, 0) + s
        got = dict(idx.search(terms, threshold))
        assert set(got) == {i for i, s in full.items() if s >= threshold - 1e-12}
        assert all(abs(got[i] - full[i]) < 1e-9 for i in got)


def test_no_passage_above_the_threshold_is_passed_over():
    """The bound by rare terms: every passage with an item at the threshold is searched."""
    rnd = random.Random(9)
    items = [(i, " ".join(f"t{rnd.randrange(80)}" for _ in range(12))) for i in range(40)]
    idx = D.Index(items)
    texts = [" ".join(f"t{rnd.randrange(80)}" for _ in range(rnd.randrange(200))) + " " + items[rnd.randrange(40)][1] for _ in range(100)]
    from stridelake.llm import _text as X

    got = {(r, i) for r, i, *_ in idx.matches(*D._words(*X.buffers(pa.array(texts))))}
    assert got >= {(r, i) for r, t in enumerate(texts) for i, (_, q) in enumerate(items) if f" {q} " in f" {t} "}


def test_odd_rows(spark, make, odd):
    assert D.contaminated(make(odd), bench(spark, ITEMS)).collect() == []
    items = [(1, "one", None, None), (2, None, None, None), (3, "", None, None), (None, "long5 long6 long7", None, None), (4, "wörds and", None, None)] * 2
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(make(odd), bench(spark, items)).collect()), key=str)
    assert got == sorted([(6, 4), (7, 4), (9, -(1 << 63))], key=str)  # one word alone is no item
    assert D.contaminated(make(odd), bench(spark, [])).collect() == []
    assert D.contaminated(make(odd).filter("doc_id > 99"), bench(spark, items)).collect() == []


def plain(docs, items):
    """{(doc_id, item_id): (score, question overlap, answer overlap)} by plain scoring of every passage against every item."""
    import math
    import re

    split = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    words = {i: split(t) for i, t in items if len(split(t)) >= D.LEAST_ITEM}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    part = {}
    for i, t in items:
        if i in words:
            lines = [x for x in t.split("\n") if split(x)]
            cut = len(split("\n".join(lines[:-1]))) if len(lines) > 1 else (len(words[i]) + 1) // 2
            part[i] = (words[i][:cut], words[i][cut:])
    gain = {}
    for i, w in words.items():
        x = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * (D.K1 + 1) / (w.count(t) + D.K1 * (1 - D.B + D.B * len(w) / mean)) for t in set(w)}
        gain[i] = {t: v / sum(x.values()) for t, v in x.items()}
    step = max(D.LEAST_PASSAGE, 2 * max(map(len, words.values()))) // 2
    out = {}
    for d, t in docs:
        w = split(t)
        for lo in range(0, len(w), step):
            passage = w[lo : lo + 2 * step]
            for i in words:
                score = sum(v for x, v in gain[i].items() if x in set(passage))
                share = [len(runs(p, min(D.RUN, len(p))) & runs(passage, min(D.RUN, len(p)))) / len(runs(p, min(D.RUN, len(p)))) for p in part[i]]
                if score >= D.THRESHOLD and min(share) >= D.OVERLAP:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, *share))
    return out


def test_the_whole_operator_against_plain_scoring_and_in_any_number_of_shards(spark, make):
    rnd = random.Random(12)
    pool = [f"t{i}" for i in range(60)] + ["the", "of", "Über", "日本"] * 6
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(2, 14))) + rnd.choice(["", "?\nanswer " + rnd.choice(pool), "\n" + rnd.choice(pool)]), None, None) for i in range(60)]
    rows = []
    for d in range(80):
        text = [rnd.choice(pool) for _ in range(rnd.randrange(150))]
        for _ in range(rnd.randrange(3)):
            q = items[rnd.randrange(60)][1].split()
            if rnd.random() < 0.4:
                q[rnd.randrange(len(q))] = "other"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = q
        rows.append((d, " ".join(text)))
    want = plain(rows, [x[:2] for x in items])
    assert len(want) > 40
    first = None
    for size in (1 << 20, 800, 300, 40):
        got = D.contaminated(make(rows), bench(spark, items), shard_bytes=size).collect()
        exact = sorted((r.doc_id, r.item_id, r.score, r.question_overlap, r.answer_overlap) for r in got)
        first = first or exact
        assert exact == first
    assert {(d, i) for d, i, *_ in first} == set(want)
    assert all(abs(a - b) < 1e-9 for d, i, *x in first for a, b in zip(x, want[d, i], strict=True))
