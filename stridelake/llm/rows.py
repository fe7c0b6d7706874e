"""Applying an operator's decisions to the rows they were made on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ID, _FP = "__stridelake_id", "__stridelake_fp"


def select_rows(docs: DataFrame, decided: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` joined on (id, fp) with ``decided``; ``how`` is 'left_semi', 'left_anti' or 'inner'.

    ``fp`` is the hash of the text that operators return beside the id.  Only
    the columns of ``docs`` come out.  With 'inner' a row is repeated for each
    matching decision.
    """
    named = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(id_col).cast("long").alias(_ID), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(_FP))
    decided = decided.select(F.col(id_col).alias("i"), F.col("fp").alias("f")).hint("merge")
    return named.join(decided, F.col(_ID).eqNullSafe(F.col("i")) & (F.col(_FP) == F.col("f")), how).select(*(F.col(f"`{c}`") for c in docs.columns))
