"""Chat formatting of reply trees, in DataFrame functions only.

Messages point to the message they reply to.  Pointers are doubled by self-joins:
after round k every message knows its ancestor 2**k steps up, its depth and the
sum of scores on the way, so trees of depth d take about log2(d) rounds.  Branches of
a root are ranked by the total score of the path from root to leaf.  The
chosen leaves' paths are then gathered downwards over the same pointers, which
touches each message of a chosen path once, and each path is formatted as one conversation.

Template: ``### Role:\\n text \\n</turn>\\n``.  In roles and texts a backslash
becomes ``\\b``, ``#`` becomes ``\\h`` and ``<`` becomes ``\\l``, so no text holds a
control string, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm._store import cut

OPEN, MIDDLE, CLOSE = "### ", ":\n", "\n</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escape_line(c: Column) -> Column:
    """For roles, which end at the first line break."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_line(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def _messages(messages: DataFrame) -> DataFrame:
    """Distinct messages, each with a number of its own (``m``) and the number of the message it replies to (``up``, null for a root)."""
    cols = ["tree", "node", "parent", "role", "text"]
    rows = messages.select(*cols, F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).distinct()
    rows = cut(rows.withColumn("m", F.monotonically_increasing_id()), "messages")  # written, so the numbers stand
    first = rows.filter("node is not null").groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(F.min_by("m", F.xxhash64("parent", "role", "text", "score")).alias("up"))
    return cut(rows.join(first, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").drop("t", "n"), "replies")


def _chosen(m: DataFrame, top: int | None) -> DataFrame:
    """(tree, root, leaf, rank, m, depth): the nodes of the best branches, with the names of root and leaf."""
    start = m.select("m", "tree", "node", "up", "score", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(F.col("up").isNull(), F.struct("m", "node")).alias("root"))
    # messages that have reached their root are written once; the others are pointed twice as far up each round
    rounds, done, limit = [], start.filter("up is null"), m.count()
    step = cut(start.filter("up is not null"), "pointers")
    while not step.isEmpty() and (1 << len(rounds)) <= limit:
        rounds.append(step)
        ends = lambda d: d.select(F.col("m").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"), F.col("root").alias("root2"))
        risen = step.join(ends(done).unionByName(ends(step)), "up")
        risen = risen.select("m", "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("root2").alias("root"))
        risen = cut(risen, "pointers")
        done, step = done.unionByName(risen.filter("up is null")), risen.filter("up is not null")
    inner = m.filter("up is not null").select(F.col("up").alias("m")).distinct()
    leaves = done.join(inner, "m", "left_anti")
    order = Window.partitionBy("root.m").orderBy(F.desc("score"), "node", "m")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    got = cut(ranked.select("tree", "root", F.col("node").alias("leaf"), "rank", "m", "depth"), "leaves")
    for k in reversed(range(len(rounds))):  # all ancestors at distances whose binary digits have been seen
        more = got.join(rounds[k].select("m", "up"), "m").select("tree", "root", "leaf", "rank", F.col("up").alias("m"), (F.col("depth") - (1 << k)).alias("depth"))
        got = cut(got.unionByName(more), "path")
    return got


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, root, leaf, rank, node, depth) for the nodes of each root's ``top`` best branches (all if None).

    ``messages`` has tree, node, parent (null for a root), role, text and score.
    Branches are ranked by the sum of scores, ties by the smaller leaf.  A message
    whose parent is missing is a root.  Rows equal in all these columns are one message.  Other
    messages that share a tree and node are several, and replies go to the one of the smallest hash of its
    contents.  A message without a node takes part, but nothing replies to it.  A null tree is a tree
    like others.  Cycles are an error of the input and never reach a root; their messages are left out.
    """
    m = _messages(messages)
    return _chosen(m, top).join(m.select("m", "node"), "m").select("tree", F.col("root.node").alias("root"), "leaf", "rank", "node", "depth")


def format_chats(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, root, leaf, rank, formatted, loss_mask) for the best branches of each root.

    ``messages``: tree, node, parent, role, text, score; see :func:`paths` for repeated, tied and
    missing ones.  Null roles and texts are empty.  ``loss_mask`` holds (start, length) in code points of every
    assistant text in ``formatted``.  An empty table gives no rows.
    """
    m = _messages(messages)
    on = _chosen(m, top).join(m.select("m", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "m")
    head = F.concat(F.lit(OPEN), escape_line(F.col("role")), F.lit(MIDDLE))
    inner = escape(F.col("text"))
    on = on.select("tree", "root", "leaf", "rank", "depth", head.alias("head"), inner.alias("inner"), (F.col("role") == "assistant").alias("learn"))
    turn = F.struct("depth", "head", "inner", "learn")
    out = on.groupBy("tree", "root", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    size = lambda t: F.char_length(t["head"]) + F.char_length(t["inner"]) + len(CLOSE)
    mask = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + size(t)).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["inner"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["inner"], F.lit(CLOSE))), "")
    return out.select("tree", F.col("root.node").alias("root"), "leaf", "rank", text.alias("formatted"), mask["spans"].alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, F.lit("\n</turn>\n")), lambda p: p != "")
    cut_at = lambda p: F.locate(MIDDLE, p)
    return F.transform(pieces, lambda p: F.struct(unescape_line(F.substring(p, F.lit(len(OPEN) + 1), cut_at(p) - len(OPEN) - 1)).alias("role"), unescape(F.substr(p, cut_at(p) + len(MIDDLE))).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
