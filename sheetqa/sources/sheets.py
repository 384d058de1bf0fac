"""From the sparse cells of a sheet, as a reader yields them, to the dense ``cells`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import doc_keys
from ..store import written
from .reshape import header_keys

BLOCK = 1 << 16
# Rows of a sheet that are widened together, and cells that one task makes at most, about.
STRIP = 64
TASK_CELLS = 1 << 20


def sheet_layout(raw: DataFrame) -> DataFrame:
    """Per sheet: its first row (the header), its last row, and its range of columns.

    ``raw(doc_id, sheet, sheet_row, col_idx, value[, value_type])``; absent cells are blank.
    """
    return raw.groupBy(*doc_keys(raw)).agg(
        F.min("sheet_row").alias("header_row"),
        F.max("sheet_row").alias("last_row"),
        F.min("col_idx").alias("first_col"),
        F.max("col_idx").alias("last_col"),
    )


def sheet_headers(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """``(keys, col_idx, col_key)`` for every column of each sheet's range."""
    keys = doc_keys(raw)
    columns = layout.select(
        *keys,
        F.col("header_row").alias("sheet_row"),
        F.explode(F.sequence("first_col", "last_col")).alias("col_idx"),
    )
    typed = ["value_type"] if "value_type" in raw.columns else []
    cells = raw.select(*keys, "sheet_row", "col_idx", F.col("value").alias("header"), *typed)
    # Only the header rows' cells meet the columns; the layout is small, so few cells move.
    header_rows = layout.select(*keys, F.col("header_row").alias("sheet_row"))
    cells = cells.join(header_rows, [*keys, "sheet_row"], "left_semi")
    found = columns.join(cells, [*keys, "sheet_row", "col_idx"], "left").drop("sheet_row")
    return header_keys(found).select(*keys, "col_idx", "col_key")


def tasks_for(spark: SparkSession, cells: int) -> int:
    """Tasks for so many cells: the session's number, more where one would hold too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells // TASK_CELLS))


def _grid_tasks(layout: DataFrame) -> int:
    """Tasks for all rows of all sheets: they grow with the grid, so what one task holds does not."""
    rows = F.col("last_row") - F.col("header_row")
    width = F.col("last_col") - F.col("first_col") + 1
    cells = layout.agg(F.sum((rows * width).cast("bigint"))).first()[0] or 0
    return tasks_for(layout.sparkSession, cells)


def parse_sheet(raw: DataFrame) -> DataFrame:
    """``cells`` of all rows below the header row; blanks are ''. A second header line is data.

    Every row of the range is there, blank ones too. The grid grows from one row per sheet in
    two steps with a shuffle between them, so that one long sheet is built by many tasks. What
    moves is one row per strip of ``STRIP`` sheet rows, with the header list, and the cells; the
    cells of a strip meet there, and only then is it widened.
    """
    keys = doc_keys(raw)
    # Both are tiny next to the cells and used more than once: keep them, scan the cells less.
    layout = written(sheet_layout(raw), "layout")
    headers = written(sheet_headers(raw, layout), "headers")
    # A sheet's columns are bounded by the format's width.
    named = headers.groupBy(*keys).agg(
        F.collect_list(F.struct("col_idx", "col_key")).alias("_headers")
    )
    # A fixed number: by their size alone, AQE would merge the few rows into one task.
    tasks = _grid_tasks(layout)
    block = F.expr(f"explode(sequence((header_row + 1) div {BLOCK}, last_row div {BLOCK}))")
    blocks = (
        layout.filter("last_row > header_row")
        .join(named, keys)
        .select(*keys, "header_row", "last_row", "_headers", block.alias("_block"))
        .repartition(tasks, *keys, "_block")
    )
    first = F.greatest(F.col("header_row") + 1, F.col("_block") * BLOCK)
    last = F.least(F.col("last_row"), (F.col("_block") + 1) * BLOCK - 1)
    strip = F.expr(f"sheet_row div {STRIP}").alias("_strip")
    strips = blocks.select(
        *keys, "header_row", "last_row", "_headers", first.alias("_first"), last.alias("_last")
    ).select(
        *keys, "header_row", "last_row", "_headers",
        F.explode(F.expr(f"sequence(_first div {STRIP}, _last div {STRIP})")).alias("_strip"),
    ).repartition(tasks, *keys, "_strip")
    kind = F.col("value_type") if "value_type" in raw.columns else F.lit("string")
    cells = (
        raw.select(
            *keys,
            strip,
            F.struct(
                "sheet_row",
                "col_idx",
                F.lit(1).alias("tag"),
                F.lit(None).cast("string").alias("col_key"),
                "value",
                kind.alias("value_type"),
            ).alias("_cell"),
        )
        .repartition(tasks, *keys, "_strip")
        .groupBy(*keys, "_strip")
        .agg(F.collect_list("_cell").alias("_cells"))
    )
    full = strips.join(cells.hint("merge"), [*keys, "_strip"], "left")
    empty = F.lit(None).cast("string")
    start = F.greatest(F.col("header_row") + 1, F.col("_strip") * STRIP)
    end = F.least(F.col("last_row"), (F.col("_strip") + 1) * STRIP - 1)
    marks = F.flatten(
        F.transform(
            F.sequence(start, end),
            lambda row: F.transform(
                "_headers",
                lambda h: F.struct(
                    row.alias("sheet_row"),
                    h["col_idx"].alias("col_idx"),
                    F.lit(0).alias("tag"),
                    h["col_key"].alias("col_key"),
                    empty.alias("value"),
                    empty.alias("value_type"),
                ),
            ),
        )
    )
    everything = F.concat(marks, F.coalesce("_cells", F.array().cast(cells.schema["_cells"].dataType)))

    def widened(sorted_: Column) -> Column:
        """Sorted by row and column, a header stands right before its cell, if it has one."""

        def one(x: Column, i: Column) -> Column:
            after = F.get(sorted_, i + 1)
            own = (after["tag"] == 1) & (after["sheet_row"] == x["sheet_row"]) & (after["col_idx"] == x["col_idx"])
            value = F.when(own, after["value"])
            cell = F.struct(
                (x["sheet_row"] - F.col("header_row") - 1).alias("row_idx"),
                x["col_idx"].alias("col_idx"),
                x["col_key"].alias("col_key"),
                F.coalesce(value, F.lit("")).alias("value"),
                F.when(value.isNull(), "string").otherwise(after["value_type"]).alias("value_type"),
            )
            return F.when(x["tag"] == 0, cell)

        return F.array_compact(F.transform(sorted_, one))

    return full.select(*keys, F.inline(let(F.sort_array(everything), widened)))
