"""Between header rows, wide rows and long cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..ranking import ranked
from ..schema import cell_keys, doc_keys, row_keys


def header_keys(header_cells: DataFrame) -> DataFrame:
    """Add ``col_key``: the header text, repeated ones as ``X_1``, ``X_2``, blanks ``__EMPTY``.

    ``header_cells(doc_id, sheet, col_idx, header[, value_type])``.
    """
    blank = F.coalesce(F.col("header") == "", F.lit(True))
    if "value_type" in header_cells.columns:
        zero = (F.col("value_type") == "number") & (F.col("header").try_cast("double") == 0)
        false = (F.col("value_type") == "boolean") & (F.lower("header") == "false")
        blank = blank | F.coalesce(zero | false, F.lit(False))
    based = header_cells.withColumn(
        "_base", F.when(blank, F.lit("__EMPTY")).otherwise(F.col("header"))
    )
    numbered = ranked(based, [*doc_keys(header_cells), "_base"], "col_idx", "_seen")
    suffix = F.when(F.col("_seen") == 1, F.lit("")).otherwise(
        F.concat(F.lit("_"), (F.col("_seen") - 1).cast("string"))
    )
    return numbered.withColumn("col_key", F.concat(F.col("_base"), suffix)).drop("_base", "_seen")


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "number" if isinstance(data_type, T.NumericType) else "string"


def to_cells(df: DataFrame, key_cols: Sequence[str], value: str = "value") -> DataFrame:
    """Wide rows to ``(row keys, col_idx, col_key, value, value_type)``; a missing cell is ''.

    ``key_cols`` are the columns to unpivot, in sheet order. Every row widens in place: no
    shuffle.
    """
    cells = []
    for name in key_cols:
        cell = F.col(f"`{name}`")
        kind = F.when(cell.isNull(), "string").otherwise(_kind(df.schema[name].dataType))
        cells.append(
            F.struct(
                F.lit(name).alias("col_key"),
                F.coalesce(cell.cast("string"), F.lit("")).alias(value),
                kind.alias("value_type"),
            )
        )
    keep = row_keys(df)
    return df.select(*keep, F.posexplode(F.array(*cells)).alias("col_idx", "c")).select(
        *keep, "col_idx", "c.*"
    )


def to_rows(
    cells: DataFrame,
    key_list: Sequence[str],
    value: str = "translated",
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Long cells back to wide rows with the columns of ``key_list``.

    A row's cells meet in one map, bounded by the sheet's width: one shuffle, where a pivot
    takes two. Headers like ``X, X, X_1`` give two columns one key: the last ``col_idx`` wins.
    """
    keys = row_keys(cells)
    place = F.col("col_idx") if "col_idx" in cells.columns else F.lit(0)
    entries = F.array_sort(F.collect_list(F.struct(place.alias("at"), "col_key", F.col(value).alias("value"))))
    rows = cells.groupBy(*keys).agg(entries.alias("_entries"))
    rows = rows.withColumn("_cells", _last_of_each(F.col("_entries")))

    def column(name: str) -> Column:
        cell = F.try_element_at("_cells", F.lit(name))
        return (cell.try_cast(types[name]) if types and name in types else cell).alias(name)

    return rows.select(*keys, *[column(name) for name in key_list])


def _last_of_each(entries: Column) -> Column:
    """A map of ordered entries; of entries with one key, the last. Most rows repeat none."""
    names = F.transform(entries, lambda e: e["col_key"])
    return let(
        names,
        lambda n: F.map_from_entries(
            F.transform(
                F.when(F.size(F.array_distinct(n)) == F.size(n), entries).otherwise(
                    F.filter(
                        entries, lambda e, i: ~F.array_contains(F.slice(n, i + 2, F.size(n)), e["col_key"])
                    )
                ),
                lambda e: F.struct(e["col_key"], e["value"]),
            )
        ),
    )


def write_back(
    base: DataFrame, updates: DataFrame, overwrite_formulas: bool = False
) -> DataFrame:
    """Write ``updates(keys, value[, value_type])`` into ``base`` cells.

    ``base(keys, value[, value_type], is_formula)`` holds every cell of the sheet's range, so
    updates beyond it meet nothing and fall away. An update that is absent changes nothing; a
    NULL one writes ''. A formula cell is skipped, or overwritten and no formula any more;
    ``skipped_formula`` and ``overwritten_formula`` mark both cases.
    """
    keys = cell_keys(base)
    typed = "value_type" in base.columns
    kind = F.col("value_type") if "value_type" in updates.columns else F.lit("string")
    new = updates.select(
        *keys,
        F.coalesce(F.col("value"), F.lit("")).alias("_new"),
        F.when(F.col("value").isNull(), "string").otherwise(kind).alias("_new_type"),
        F.lit(True).alias("_given"),
    )
    given = F.coalesce(F.col("_given"), F.lit(False))
    formula = F.coalesce(F.col("is_formula"), F.lit(False))
    write = given if overwrite_formulas else given & ~formula
    out = base.join(new, keys, "left").select(
        *[c for c in base.columns if c not in ("value", "value_type", "is_formula")],
        F.when(write, F.col("_new")).otherwise(F.col("value")).alias("value"),
        *(
            [F.when(write, F.col("_new_type")).otherwise(F.col("value_type")).alias("value_type")]
            if typed
            else []
        ),
        (formula & ~write).alias("is_formula"),
        (given & formula & ~write).alias("skipped_formula"),
        (formula & write).alias("overwritten_formula"),
    )
    return out


def write_back_counts(written: DataFrame) -> DataFrame:
    return written.agg(
        F.count_if("overwritten_formula").alias("overwritten_formulas"),
        F.count_if("skipped_formula").alias("skipped_formulas"),
    )

