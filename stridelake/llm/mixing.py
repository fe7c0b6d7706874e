"""Mixing sources to target weights by hierarchical budgeting.

Weights stand on the edges of a tree, for instance domain, language, source.  A
budget of tokens flows down from the root.  A node divides its budget among its
children by weight; a child can take no more than ``epochs`` times the tokens
below it, and what it can't take goes to its siblings, by weight, until they are
full too.  Only what a whole family can't take is left to the ancestors, who
have divided with that family's capacity in view.

A leaf's documents stand in an order of hashes of seed, epoch and id; a leaf takes whole
epochs and then the prefix of the next one whose tokens fit what is left.  The
prefix's end is found by counting tokens by ever finer ranges of the order's hash,
so no task orders a whole leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm._store import cut, gathered

BROADCAST_LEAVES = 100_000
EXACT = 2048
STEP_BITS = 10
BITS = 60


def _weight(weights: Mapping[tuple, float], names: list[str]) -> Column:
    """A child's weight: by its path, then by (depth, name), else 1."""
    depth = len(names) - 1
    paths = {k: float(v) for k, v in weights.items() if len(k) == len(names) and all(isinstance(x, str) for x in k)}
    plain = {k[1]: float(v) for k, v in weights.items() if len(k) == 2 and not isinstance(k[0], str) and k[0] == depth}
    out = F.lit(1.0)
    for table, key in ((plain, F.col(names[-1])), (paths, F.array(*names))):
        if table:
            pairs = [(F.lit(k) if isinstance(k, str) else F.array(*map(F.lit, k)), F.lit(v)) for k, v in table.items()]
            out = F.coalesce(F.try_element_at(F.create_map(*(x for kv in pairs for x in kv)), key), out)
    return out


def allocate(leaves: DataFrame, names: list[str], weights: Mapping[tuple, float], budget: float) -> DataFrame:
    """(names, given) for leaves (names, cap): a budget divided level by level.

    Within a family the children stand in the order of capacity for weight.  A child is full if what the smaller
    ones leave, divided by weight, is more than it can take; the others share what the full ones leave.
    Children without weight or capacity get nothing.
    """
    given = None
    for d in range(1, len(names) + 1):
        path, up = names[:d], names[: d - 1]
        kids = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(weights, path))
        kids = kids.withColumn("budget", F.lit(float(budget))) if given is None else kids.join(given.withColumnRenamed("given", "budget"), up)
        thirsty = (F.col("w") > 0) & (F.col("cap") > 0)
        kids = kids.withColumn("dry", ~thirsty).withColumn("ratio", F.when(thirsty, F.col("cap") / F.col("w")))
        family = Window.partitionBy("dry", *up)
        order = family.orderBy("ratio", names[d - 1])
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        kids = kids.withColumn("full", F.col("ratio") <= (F.col("budget") - before) / onward)
        rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0.0))
        share = F.col("w") * rest / F.sum(F.when(~F.col("full"), F.col("w"))).over(family)
        given = kids.select(*path, F.when(F.col("dry"), 0.0).when(F.col("full"), F.col("cap")).otherwise(F.greatest(share, F.lit(0.0))).alias("given"))
    return given


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], budget: float, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return a row for each document and epoch taken: (id, fp, the levels, epoch, n_tokens, leaf_budget).

    ``budget`` is a number of tokens, or at most 1 a share of all tokens.  Tokens are
    words.  A null or empty text has none and comes with its leaf's whole epochs
    and with prefixes that reach it.  A null level is a node of its own, named by the empty
    string.  Repeated rows are counted, and taken or left, together; rows
    that tie in the order are told apart by id and text, rows without an id by their text.  ``fp`` is a hash of
    the text.  An empty table gives no rows.  Any number of leaves is divided by grouped sums and windows over
    families, which hold a row a child; the plan is broadcast up to ``BROADCAST_LEAVES`` leaves and joined beyond.
    """
    names = list(levels)
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"),
        *(F.coalesce(levels[n].cast("string"), F.lit("")).alias(n) for n in names),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_tokens"),
    )
    rows = cut(src.groupBy("id", "fp", *names, "n_tokens").agg(F.count(F.lit(1)).alias("copies")), "rows")
    leaves = cut(gathered(rows.groupBy(*names).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")), rows.count()), "leaves")
    count, total = leaves.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total = total or 0
    wanted = min(float(int(budget * total) if budget <= 1 else int(budget)), float(epochs * total))
    given = allocate(leaves.select(*names, (F.lit(float(epochs)) * F.col("tokens")).alias("cap")), names, weights, wanted)
    plans = leaves.join(given, names).withColumn("leaf_budget", F.least(F.floor(F.col("given") + 1e-6), F.col("tokens") * epochs))
    plans = plans.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(epochs).cast("int"))
    plans = cut(gathered(plans.select(*names, "leaf_budget", "whole", (F.col("leaf_budget") - F.col("whole") * F.col("tokens")).alias("rest")), count), "plan")
    side: Callable[[DataFrame], DataFrame] = F.broadcast if count <= BROADCAST_LEAVES else lambda x: x
    rows = rows.join(side(plans), names)
    keep = ["id", "fp", *names, "n_tokens", "leaf_budget", "copies"]
    taken = rows.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*keep, "epoch")
    key = F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.col("fp").cast("string"))))
    part = rows.filter("rest > 0").withColumn("order", F.conv(F.substring(F.sha2(key, 256), 1, BITS // 4), 16, 10).cast("long"))
    prefix = _prefix(part, names, side, count).select(*keep, F.col("whole").alias("epoch"))
    out = taken.unionByName(prefix).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("id").alias(id_col), "fp", *names, "epoch", "n_tokens", "leaf_budget")


def _prefix(part: DataFrame, names: list[str], side: Callable[[DataFrame], DataFrame], leaves: int) -> DataFrame:
    """Rows whose tokens, summed in ``order`` over their leaf, stay within ``rest``."""
    leaf = Window.partitionBy(*names)
    weight = F.col("n_tokens") * F.col("copies")
    edge, shift = None, BITS
    while shift > 0:
        shift = max(0, shift - STEP_BITS)
        bucket = F.shiftright("order", shift)
        inside = part
        if edge is not None:  # only the range in which each leaf's prefix ends is counted more finely
            inside = part.join(side(edge.select(*names, "bucket", "before")), names).filter(F.shiftright("order", shift + STEP_BITS) == F.col("bucket")).drop("bucket")
        else:
            inside = part.withColumn("before", F.lit(0).cast("long"))
        sums = inside.groupBy(*names, "rest", "before", bucket.alias("bucket")).agg(F.sum(weight).alias("tokens"), F.count(F.lit(1)).alias("n"))
        upto = F.col("before") + F.sum("tokens").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        edge = over.groupBy(*names).agg(F.min(F.struct("bucket", F.expr("upto - tokens"), "n")).alias("e"))
        edge = cut(gathered(edge.select(*names, F.col("e.bucket").alias("bucket"), F.col("e.col2").alias("before"), F.col("e.n").alias("n")), leaves), "edge")
        if (edge.agg(F.max("n")).first()[0] or 0) <= EXACT:
            break
    at = part.join(side(edge.select(*names, "bucket", "before")), names, "left").withColumn("own", F.shiftright("order", shift))
    clear = at.filter(F.col("bucket").isNull() | (F.col("own") < F.col("bucket")))
    close = at.filter(F.col("own") == F.col("bucket"))
    run = F.sum(weight).over(leaf.orderBy("order", "id", "fp").rowsBetween(Window.unboundedPreceding, 0))
    close = close.withColumn("run", F.col("before") + run).filter(F.col("run") <= F.col("rest")).drop("run")
    return clear.unionByName(close)
