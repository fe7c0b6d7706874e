import random
from collections import defaultdict
from collections.abc import Mapping, Sequence

import pytest
from pyspark.sql import functions as F

from stridelake.llm import mixing as M


def divide(budget: float, children: Sequence[tuple[object, float, float]]) -> dict[object, float]:
    """Water-filling: shares of ``budget`` for (name, weight, capacity), shortages going to the siblings."""
    out = {name: 0.0 for name, _, _ in children}
    left, thirsty = float(budget), [c for c in children if c[1] > 0 and c[2] > 0]
    while thirsty and left > 0:
        total = sum(w for _, w, _ in thirsty)
        full = [c for c in thirsty if c[2] <= left * c[1] / total]
        if not full:
            for name, w, _ in thirsty:
                out[name] = left * w / total
            break
        for name, _, cap in full:
            out[name] = cap
        left -= sum(c[2] for c in full)
        names = {c[0] for c in full}
        thirsty = [c for c in thirsty if c[0] not in names]
    return out


def allocate(leaves: Mapping[tuple, int], weights: Mapping[tuple, float], budget: int, epochs: int) -> dict[tuple, int]:
    """Whole tokens for each leaf path.  A weight is looked up by path, then by (depth, name), else it is 1."""
    capacity: dict[tuple, float] = defaultdict(float)
    children: dict[tuple, set] = defaultdict(set)
    for path, tokens in leaves.items():
        for d in range(len(path) + 1):
            capacity[path[:d]] += epochs * tokens
            if d:
                children[path[: d - 1]].add(path[:d])
    given = {(): min(float(budget), capacity[()])}
    for depth in range(max(map(len, leaves), default=0)):
        for node in [n for n in given if len(n) == depth]:
            kids = sorted(children[node], key=str)
            given |= divide(given[node], [(k, float(weights.get(k, weights.get((depth, k[-1]), 1.0))), capacity[k]) for k in kids])
    return {path: min(int(given.get(path, 0.0) + 1e-6), epochs * tokens) for path, tokens in leaves.items()}


def test_shares_follow_weights_and_shortages_go_to_siblings():
    assert divide(90, [("a", 1, 100), ("b", 2, 100)]) == {"a": 30.0, "b": 60.0}
    assert divide(90, [("a", 1, 100), ("b", 2, 10)]) == {"a": 80.0, "b": 10.0}
    assert divide(90, [("a", 1, 20), ("b", 2, 10)]) == {"a": 20.0, "b": 10.0}
    assert divide(90, [("a", 1, 50), ("b", 1, 20), ("c", 1, 100)]) == {"a": 35.0, "b": 20.0, "c": 35.0}
    assert divide(10, [("a", 0, 50), ("b", 0, 20)]) == {"a": 0.0, "b": 0.0}
    assert divide(0, [("a", 1, 50)]) == {"a": 0.0}


def test_siblings_come_before_ancestors():
    leaves = {("x", "p"): 10, ("x", "q"): 100, ("y", "r"): 100}
    assert allocate(leaves, {}, 100, 1) == {("x", "p"): 10, ("x", "q"): 40, ("y", "r"): 50}
    assert allocate({("x", "p"): 10, ("x", "q"): 20, ("y", "r"): 100}, {}, 100, 1) == {("x", "p"): 10, ("x", "q"): 20, ("y", "r"): 70}


def test_allocation_is_whole_and_within_bounds():
    rnd = random.Random(2)
    for _ in range(200):
        leaves = {(rnd.choice("ab"), rnd.choice("cd"), str(i)): rnd.randrange(1, 100) for i in range(rnd.randrange(1, 9))}
        epochs, budget = rnd.randrange(1, 4), rnd.randrange(0, 900)
        got = allocate(leaves, {(0, "a"): rnd.random() + 0.1}, budget, epochs)
        assert all(0 <= got[p] <= epochs * leaves[p] for p in leaves)
        assert min(budget, epochs * sum(leaves.values())) - len(leaves) <= sum(got.values()) <= budget


def levels():
    return {"top": F.col("lang"), "low": F.col("source")}


def table(make, spark, sizes, seed=0):
    rnd = random.Random(seed)
    out, d = None, 0
    for (lang, source), n in sizes.items():
        rows = []
        for _ in range(n):
            rows.append((d, " ".join("w" for _ in range(rnd.randrange(0, 12)))))
            d += 1
        part = make(rows, lang, source)
        out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("budget,epochs", [(0.5, 1), (0.9, 2), (700, 3), (0, 1), (10**9, 2)])
def test_prefixes_fill_each_budget(make, spark, monkeypatch, budget, epochs):
    monkeypatch.setattr(M, "EXACT", 8)
    docs = table(make, spark, {("en", "s1"): 200, ("en", "s2"): 20, ("de", "s1"): 60, (None, "s3"): 5})
    all_rows = docs.selectExpr("doc_id", "coalesce(lang,'') top", "source low", "size(filter(split(text,' '), x -> x<>'')) n").collect()
    got = M.mix(docs, levels(), {("en",): 2.0}, budget, epochs, seed=4).collect()
    size = {}
    for r in all_rows:
        size.setdefault((r.top, r.low), []).append(r)
    seen = [(r.doc_id, r.epoch) for r in got]
    assert len(seen) == len(set(seen))
    for leaf, rows in size.items():
        mine = [r for r in got if (r.top, r.low) == leaf]
        tokens = sum(r.n for r in rows)
        given = next((r.leaf_budget for r in mine), 0)
        by_epoch = {}
        for r in mine:
            by_epoch.setdefault(r.epoch, set()).add(r.doc_id)
        whole = given // tokens if tokens else epochs
        assert all(by_epoch[e] == {r.doc_id for r in rows} for e in range(whole))
        taken = sum(r.n_tokens for r in mine)
        longest = max(r.n for r in rows)
        assert taken <= given and (given - taken < longest or not mine)


def test_prefix_is_that_of_the_seeded_order(make, spark, monkeypatch):
    docs = table(make, spark, {("en", "s1"): 300})
    key = lambda r: (r.doc_id, r.epoch)
    few = {key(r) for r in M.mix(docs, levels(), {}, 0.3, 1, seed=1).collect()}
    more = {key(r) for r in M.mix(docs, levels(), {}, 0.6, 1, seed=1).collect()}
    assert few < more
    monkeypatch.setattr(M, "EXACT", 2)
    assert few == {key(r) for r in M.mix(docs, levels(), {}, 0.3, 1, seed=1).collect()}
    assert few != {key(r) for r in M.mix(docs, levels(), {}, 0.3, 1, seed=2).collect()}


def test_odd_rows(make, odd):
    got = M.mix(make(odd + odd), levels(), {}, 1.0, 1).collect()
    assert len(got) == 2 * len(odd)
    assert M.mix(make(odd).filter("doc_id > 99"), levels(), {}, 1.0, 1).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_leaves_are_divided_like_the_plain_twin(make, spark, monkeypatch, seed):
    if seed % 2:
        monkeypatch.setattr(M, "BROADCAST_LEAVES", 0)
    rnd = random.Random(seed)
    leaves = {(rnd.choice("abc"), rnd.choice("de"), f"s{i % 9}"): rnd.choice([0, 1, 5, 40, 300]) for i in range(40)}
    weights = {(0, "a"): 3.0, (0, "b"): 0.0 if seed == 2 else 0.5, (1, "d"): 2.0, (2, "s3"): 7.0, ("c", "e"): 5.0, ("a", "d", "s1"): 0.25}
    df = spark.createDataFrame([(*k, float(2 * v)) for k, v in leaves.items()], "x string, y string, z string, cap double")
    for budget in (0, 50, 1000, 10**6):
        total = 2 * sum(leaves.values())
        got = {(r.x, r.y, r.z): int(r.given + 1e-6) for r in M.allocate(df, ["x", "y", "z"], weights, min(budget, total)).collect()}
        assert got == allocate(leaves, weights, budget, 2)


def test_many_leaves_are_no_error(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"))
    got = M.mix(docs, levels(), {}, 1.0, 1)
    assert got.count() == 3000


def test_rows_without_ids_are_ordered_by_their_texts(make, spark):
    docs = make([(None, "w " * (1 + i % 7) + str(i)) for i in range(200)])
    got = M.mix(docs, levels(), {}, 0.5, 1, seed=3).collect()
    tokens = sum(2 + i % 7 for i in range(200))
    assert tokens // 2 - 9 < sum(r.n_tokens for r in got) <= tokens // 2
    assert len({r.fp for r in got}) == len(got)
