"""Names of the canonical tables' columns.

``cells(doc_id, sheet, row_idx, col_idx, col_key, original, translated, value_type)``

``doc_id`` and ``sheet`` may be absent (one sheet); ``value_type`` in string, number, boolean
may be absent (all strings), and ``original_type`` / ``translated_type`` override it where the
two sides differ. A NULL value means the row has no such key. Rows have no order of their own
in Spark, so ``row_idx`` is an explicit column everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_keys(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "sheet") if c in df.columns]


def row_keys(df: DataFrame) -> list[str]:
    return [*doc_keys(df), "row_idx"]


def cell_keys(df: DataFrame) -> list[str]:
    return [*row_keys(df), "col_key"]


def is_string(df: DataFrame, side: str) -> Column:
    """Is this side (``original``, ``translated`` or ``value``) present and a string?"""
    for name in (f"{side}_type", "value_type"):
        if name in df.columns:
            return F.col(side).isNotNull() & F.coalesce(F.col(name) == "string", F.lit(True))
    return F.col(side).isNotNull()


def text_of(df: DataFrame, side: str) -> Column:
    """The value where it is a string, else NULL."""
    return F.when(is_string(df, side), F.col(side))
