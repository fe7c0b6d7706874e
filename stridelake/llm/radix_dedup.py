"""Exact deduplication by distributed MSD radix partitioning.

The length of a text in bytes is its first digit; the digits that follow are
runs of its bytes, the first run short and each later one longer.  A group is
split by the next digit until it holds one row or its texts have ended.  Rows
are equal because all their digits were equal; no digest decides.  Digits are 64 bytes, then
4,096, then 64 times more up to a mebibyte, so most groups end in two rounds.  A group is
named by the number of one of its rows, numbers that are fixed once the rows are written.

Every round writes two tables to the shared folder: the groups with more than
one row, and the rows with what is left of their text.  Counting a digit
combines on the map side, and the join back is a plain join of two tables whose
skewed partitions adaptive execution splits, so a group that holds a third of
all rows costs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm._store import cut

FIRST_DIGIT = 64
GROWTH = 64
LONGEST_DIGIT = 1 << 20


def radix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return one row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the largest id stays.  A null text counts as empty.  A null
    id is smaller than every id, and stays only in a group without another id.
    Rows that repeat both id and text are reported alike, and ``kept`` is true
    for each of them if their id stays.  An empty table gives no rows.  Other
    columns, whatever their names, are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("rest")).select(
        "id", "rest", F.sha2("rest", 256).alias("sha"), F.monotonically_increasing_id().alias("h"), F.octet_length("rest").cast("long").alias("g")
    )
    done, size, left = [], FIRST_DIGIT, None
    while True:
        head, tail = F.substring("rest", 1, size), F.expr(f"substring(rest, {size + 1})")
        groups = cut(
            base.groupBy("g", head.alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("name"), F.max("id").alias("keep_id"), F.max(F.octet_length("rest")).alias("left"))
            .filter("n > 1"),
            "groups",
        )
        left = groups.agg(F.max("left")).first()[0]
        rows = base.withColumn("digit", head).join(groups.hint("merge"), ["g", "digit"], "left")
        ends = F.col("left").isNull() | (F.col("left") <= size)
        rows = cut(
            rows.select(
                "id", "sha", "h", ends.alias("ends"), F.col("name").alias("g"),
                F.when(~ends, tail).alias("rest"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"),
            ),
            "rows",
        )
        done.append(rows.filter("ends").select("id", "keep_id", "n", "sha"))
        if left is None or left <= size:
            break
        base = rows.filter("not ends").select("id", "rest", "sha", "h", "g")
        size = min(size * GROWTH, LONGEST_DIGIT)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
