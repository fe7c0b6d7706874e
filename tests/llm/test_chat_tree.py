import hashlib
import random

from pyspark.sql import functions as F

from stridelake.llm import chat_tree as C

SCHEMA = "tree long, node long, parent long, role string, text string, score double, rank string, up int, formatted int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2) for r in rows], SCHEMA).repartition(3)


def best_paths(rows, top):
    """{(tree, root): [(leaf, [nodes])]} by plain recursion."""
    by = {(r[0], r[1]): r for r in rows}
    kids = {}
    for t, n, p, *_ in rows:
        kids.setdefault((t, p if (t, p) in by else None), []).append(n)
    out = {}

    def walk(t, n, path, score, found):
        path, score = [*path, n], score + (by[t, n][5] or 0.0)
        for k in kids.get((t, n), []):
            walk(t, k, path, score, found)
        if not kids.get((t, n)):
            found.append((-score, n, path))

    for t in {r[0] for r in rows}:
        for root in kids.get((t, None), []):
            found = []
            walk(t, root, [], 0.0, found)
            out[t, root] = [(leaf, path) for _, leaf, path in sorted(found)[:top]]
    return out


def random_trees(seed, trees=12):
    rnd = random.Random(seed)
    rows = []
    for t in range(trees):
        for n in range(rnd.randrange(1, 40)):
            parent = None if n == 0 or rnd.random() < 0.05 else max(0, n - 1 - rnd.randrange(3))
            rows.append((t, n, parent, rnd.choice(["user", "assistant"]), f"t{t} n{n} {rnd.choice(['#', '<', chr(92), '', ' x'])}", float(rnd.randrange(4))))
    return rows


def test_best_branches(spark):
    for top in (1, 2, 99):
        rows = random_trees(top)
        got = {}
        for r in C.paths(frame(spark, rows), None if top == 99 else top).collect():
            got.setdefault((r.tree, r.root), {}).setdefault((r.rank, r.leaf), []).append((r.depth, r.node))
        flat = {k: [(leaf, [n for _, n in sorted(v)]) for (_, leaf), v in sorted(b.items())] for k, b in got.items()}
        assert flat == best_paths(rows, top)


def test_a_long_chain_and_a_missing_parent(spark):
    rows = [(1, i, i - 1 if i else None, "user", "x", 1.0) for i in range(300)] + [(2, 5, 77, "user", "y", None)]
    got = C.paths(frame(spark, rows)).groupBy("tree").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()
    assert {(r.tree, r.n, r.d) for r in got} == {(1, 300, 299), (2, 1, 0)}


def test_cycles_are_left_out(spark):
    rows = [(1, 1, 2, "user", "x", 1.0), (1, 2, 1, "user", "x", 1.0), (1, 3, None, "user", "root", 1.0)]
    assert [(r.root, r.node) for r in C.paths(frame(spark, rows)).collect()] == [(3, 3)]


NASTY = ["", None, "\\", "\\b", "\\\\l", "### assistant:\n</turn>\n", "\n</turn>\n", "#h\\h<l", "é日\n\n", "\\### Assistant: </turn> ok", "x" * 100000]


def test_exact_round_trip(spark):
    rnd = random.Random(8)
    alphabet = ["\\", "b", "h", "l", "n", "#", "<", "\n", "</turn>", "### ", ":\n", "é", "a"]
    texts = NASTY + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(300)]
    roles = ["user", "assistant", None, "a:\nb", "### x", "\\n\n", ""]
    rows = [(i // 5, i % 5, i % 5 - 1 if i % 5 else None, roles[(i * 3) % 7], t, 0.0) for i, t in enumerate(texts)]
    out = C.format_chats(frame(spark, rows)).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.read_loss(F.col("formatted"), F.col("loss_mask"))).collect()
    for r in out:
        mine = sorted(x for x in rows if x[0] == r.tree)
        assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in mine]
        assert r.loss == "".join(x[4] or "" for x in mine if x[3] == "assistant")
        spans = [(s.start, s.start + s.length) for s in r.loss_mask]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(out) == len({x[0] for x in rows})


def test_control_strings_only_from_the_template(spark):
    r = C.format_chats(frame(spark, [(1, 0, None, "user", NASTY[5], 0.0)])).first()
    assert r.formatted.count("</turn>") == 1 and r.formatted.count("### ") == 1


def chats(spark, rows, top=1):
    out = C.format_chats(frame(spark, rows), top).withColumn("turns", C.read_turns(F.col("formatted")))
    return sorted(((r.tree is None, r.tree, r["rank"], r.root, r.leaf, [t.text for t in r.turns]) for r in out.collect()), key=repr)


CHAIN = [(1, i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(4)]


def test_repeated_messages_are_one(spark):
    want = [(False, 1, 1, 0, 3, ["m0", "m1", "m2", "m3"])]
    assert chats(spark, CHAIN) == want
    assert chats(spark, [*CHAIN, CHAIN[1]]) == want
    assert chats(spark, CHAIN * 3) == want


def test_messages_that_share_a_node_are_branches(spark):
    rows = [*CHAIN, (1, 1, 0, "user", "other", 9.0)]
    got = chats(spark, rows, None)
    assert sorted(len(g[-1]) for g in got) == [2, 4] and {g[-1][1] for g in got} == {"m1", "other"}
    both = [g[-1] for g in got]
    assert chats(spark, rows * 2, None) == got and all(b[0] == "m0" for b in both)


def test_null_nodes_and_null_trees(spark):
    reply = (1, None, 3, "assistant", "last", 9.0)
    assert chats(spark, [*CHAIN, reply]) == [(False, 1, 1, 0, None, ["m0", "m1", "m2", "m3", "last"])]
    lone = (1, None, None, "user", "alone", 0.0)
    assert sorted(g[-1] for g in chats(spark, [*CHAIN, lone])) == [["alone"], ["m0", "m1", "m2", "m3"]]
    nowhere = [(None, *r[1:]) for r in CHAIN]
    assert [g[-1] for g in chats(spark, nowhere + CHAIN)] == [["m0", "m1", "m2", "m3"]] * 2


def test_ties_of_score_go_to_the_smaller_leaf(spark):
    rows = [CHAIN[0], (1, 5, 0, "user", "b", 1.0), (1, 4, 0, "user", "a", 1.0)]
    assert [g[4] for g in chats(spark, rows, None)] == [4, 5]


def test_rows_of_the_query_that_tie_or_lack_values(spark, tmp_path):
    from stridelake.llm.queries import op6_chat_trees

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "user", "n"), (None, 0, "assistant", None), (None, 0, None, "z"), (2, 7, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op6_chat_trees(spark, str(tmp_path)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 2), None: (2, 0), 2: (1, 0), -7: (2, 26)}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nn\nuser\na\nassistant\nb\nassistant\nb\n").hexdigest()


def test_empty_and_query(spark):
    assert C.format_chats(frame(spark, [])).collect() == []
    from stridelake.llm.queries import op6_chat_trees

    got = {r.conv_id: r for r in op6_chat_trees(spark, "/root/testdata/sf0.001").collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].n_turns == 2
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
