"""Quality reports of original against translated tables, and progress figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import is_untranslated
from ..functions.quality import cjk_residue, id_mismatch, placeholder_leak, spacing_issue
from ..ranking import running
from ..schema import cell_keys, doc_keys, is_string, row_keys, text_of
from .classify import changed

# Issue types in report order.
ISSUE_TYPES = ["chinese", "placeholder", "spacing", "idMismatch"]


def pair_cells(orig: DataFrame, trans: DataFrame) -> DataFrame:
    """Match two cell tables ``(keys, value[, value_type])`` by key; either side may lack a cell.

    The key is the cell itself, so the join's partitions stay even however large one sheet is.
    """
    keys = cell_keys(orig)

    def side(df: DataFrame, name: str) -> DataFrame:
        kind = F.col("value_type") if "value_type" in df.columns else F.lit("string")
        return df.select(
            *keys,
            F.col("value").alias(name),
            kind.alias(f"{name}_type"),
            F.lit(True).alias(f"in_{name}"),
        )

    return side(orig, "original").join(side(trans, "translated"), keys, "full_outer")


def _issue_flags(cells: DataFrame) -> dict[str, Column]:
    text = text_of(cells, "translated")
    flags = {
        "chinese": cjk_residue(text),
        "placeholder": placeholder_leak(text),
        "spacing": spacing_issue(text),
        "idMismatch": text.isNotNull()
        & id_mismatch(F.col("col_key"), text_of(cells, "original"), text),
    }
    return {name: F.coalesce(flags[name], F.lit(False)) for name in ISSUE_TYPES}


def quality_issues(orig: DataFrame, trans: DataFrame | None = None) -> DataFrame:
    """Long issue list: keys, ``type``, ``value``, ``original`` ('' where it is not a string).

    One argument: a table that already pairs ``original`` and ``translated``.
    """
    cells = orig if trans is None else pair_cells(orig, trans)
    types = [F.when(flag, F.lit(name)) for name, flag in _issue_flags(cells).items()]
    extra = [c for c in ("col_idx",) if c in cells.columns]
    return cells.select(
        *cell_keys(cells),
        *extra,
        F.explode(F.array_compact(F.array(*types))).alias("type"),
        F.col("translated").alias("value"),
        F.coalesce(text_of(cells, "original"), F.lit("")).alias("original"),
    )


def quality_totals(orig: DataFrame, trans: DataFrame | None = None) -> DataFrame:
    """The ten counters, one row.

    Distinct rows come from a first aggregate per row, which combines before it shuffles,
    rather than from several ``count(distinct)``, which would multiply the cells.
    """
    cells = orig if trans is None else pair_cells(orig, trans)
    has_orig = F.col("in_original") if "in_original" in cells.columns else F.lit(True)
    has_trans = F.col("in_translated") if "in_translated" in cells.columns else F.lit(True)
    flagged = cells.select(
        *row_keys(cells),
        is_string(cells, "translated").alias("scanned"),
        F.coalesce(has_orig, F.lit(False)).alias("o"),
        F.coalesce(has_trans, F.lit(False)).alias("t"),
        *[flag.alias(name) for name, flag in _issue_flags(cells).items()],
    )
    per_row = flagged.groupBy(*row_keys(cells)).agg(
        F.count_if("scanned").alias("scanned"),
        F.bool_or("o").alias("o"),
        F.bool_or("t").alias("t"),
        *[F.count_if(name).alias(name) for name in ISSUE_TYPES],
    )
    # Rows are compared by position inside a sheet: its length is the longer side's.
    sheets = doc_keys(cells)
    per_sheet = per_row.groupBy(*sheets).agg(
        F.sum("scanned").alias("scanned"),
        F.greatest(F.count_if("o"), F.count_if("t")).alias("n_rows"),
        *[F.sum(name).alias(name) for name in ISSUE_TYPES],
        *[F.count_if(F.col(name) > 0).alias(f"{name}_rows") for name in ISSUE_TYPES],
    )

    def total(name: str, out: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(out)

    return per_sheet.agg(
        total("scanned", "cells_scanned"),
        total("n_rows", "rows_scanned"),
        total("chinese", "chinese_cells"),
        total("chinese_rows", "chinese_rows"),
        total("placeholder", "placeholder_cells"),
        total("placeholder_rows", "placeholder_rows"),
        total("idMismatch", "id_mismatches"),
        total("idMismatch_rows", "id_mismatch_rows"),
        total("spacing", "spacing_issues"),
        total("spacing_rows", "spacing_rows"),
    )


def quality_by_lang(lines: DataFrame, lang: str = "lang", content: str = "content") -> DataFrame:
    """Per target language: untranslated, placeholder and spacing counts of line contents.

    Lines of resource files repeat: each different content of a language is judged once and
    counts as often as it is there. Tasks combine what repeats before the shuffle.
    """
    text = F.col(content)
    different = lines.groupBy(lang, content).agg(F.count(F.lit(1)).alias("_lines"))

    def lines_where(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_lines")).otherwise(0))

    return different.groupBy(lang).agg(
        lines_where(is_untranslated(F.lit("content"), text, F.col(lang))).alias("untranslated"),
        lines_where(placeholder_leak(text)).alias("placeholders"),
        lines_where(spacing_issue(text)).alias("spacing"),
    )


# Shares into which a group is cut before its first rows are picked.
SHARES = 64


def first_n(df: DataFrame, by: list[str], order: list, n: int, out: str = "pos") -> DataFrame:
    """The first ``n`` rows of each group, numbered by ``out``.

    Each task cuts its own share of a group to ``n`` rows before these are shuffled; without
    groups this is a sort with a limit.
    """
    if by:
        share = Window.partitionBy(*by, F.pmod(F.xxhash64(*df.columns), F.lit(SHARES))).orderBy(*order)
        cut = df.withColumn(out, F.row_number().over(share)).filter(F.col(out) <= n)
        return (
            cut.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .filter(F.col(out) <= n)
        )
    return df.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def row_runs(df: DataFrame, idx: str = "row_idx", by: list[str] | None = None) -> DataFrame:
    """All runs of consecutive indices: ``by…, seq, first_row, last_row`` (one-based rows).

    An index that occurs again ends the run before it and starts a new one. ``seq`` orders the
    runs of a group from 1. Runs share the difference of index and distinct rank, and the
    number of repetitions before them, so an endless run combines before the shuffle.
    """
    by = by or []
    copies = df.groupBy(*by, idx).agg(F.count(F.lit(1)).alias("_copies"))
    numbered = running(copies, by, [idx], {"_rank": F.lit(1), "_repeats": F.col("_copies") - 1})
    parts = numbered.select(
        *by,
        F.col(idx).alias("_idx"),
        (F.col(idx) - F.col("_rank")).alias("_island"),
        F.explode(F.sequence(F.col("_repeats"), F.col("_repeats") + F.col("_copies") - 1)).alias("_nth"),
    )
    runs = parts.groupBy(*by, "_island", "_nth").agg(F.min("_idx").alias("_from"), F.max("_idx").alias("_to"))
    return running(runs, by, ["_from", "_nth"], {"seq": F.lit(1)}).select(
        *by,
        (F.col("seq") + 1).alias("seq"),
        (F.col("_from") + 1).alias("first_row"),
        (F.col("_to") + 1).alias("last_row"),
    )


def row_ranges(
    df: DataFrame, limit: int, idx: str = "row_idx", by: list[str] | None = None
) -> DataFrame:
    """Row indices of each group as ``1-3, 7, 9-10...``: the first ``limit`` of ``row_runs``."""
    by = by or []
    one = F.col("first_row") == F.col("last_row")
    label = F.when(one, F.col("first_row").cast("string")).otherwise(
        F.concat_ws("-", "first_row", "last_row")
    )
    runs = row_runs(df, idx, by).filter(F.col("seq") <= limit + 1)
    return _joined(runs.select(*by, F.col("seq").alias("_pos"), label.alias("_label")), by, limit, "...", "ranges")


def _joined(picked: DataFrame, by: list[str], limit: int, more: str, out: str) -> DataFrame:
    """Labels by ``_pos`` with commas; ``more`` marks that there are more than ``limit``."""
    listed = F.array_sort(F.collect_list(F.struct("_pos", "_label")))
    shown = F.array_join(F.transform(F.slice(listed, 1, limit), lambda x: x["_label"]), ", ")
    tail = F.when(F.count(F.lit(1)) > limit, F.lit(more)).otherwise("")
    return picked.groupBy(*by).agg(F.concat(shown, tail).alias(out))


def places(found: DataFrame, data_start: int = 1) -> DataFrame:
    """``place`` of every found cell: ``R{row}/{column}`` with sheet row = data start + index + 1."""
    row = (F.col("row_idx") + data_start + 1).cast("string")
    return found.withColumn("place", F.concat(F.lit("R"), row, F.lit("/"), F.col("col_key")))


def location_preview(
    found: DataFrame, n: int, data_start: int = 1, by: list[str] | None = None
) -> DataFrame:
    """The first ``n`` of ``places`` in sheet order, then ``, ...`` if there are more.

    Columns follow ``col_idx`` where it is present. Cell keys are unique, so rows are cut
    before anything else.
    """
    by = doc_keys(found) if by is None else by
    column = "col_idx" if "col_idx" in found.columns else "col_key"
    narrow = places(found, data_start).select(*by, "row_idx", F.col(column).alias("_col"), F.col("place").alias("_label"))
    return _joined(first_n(narrow, by, ["row_idx", "_col"], n + 1, "_pos"), by, n, ", ...", "preview")


def progress(rows: DataFrame) -> DataFrame:
    """Per sheet: rows done of total, percent (half rounds up), remaining, missing, write-failed.

    The percentage divides before it multiplies, both in double, so 29 of 200 is 14.

    ``rows``: one per sheet row with booleans ``done``, ``missing``, ``write_failed``.
    """
    done, total = F.col("done_rows"), F.col("total_rows")
    return (
        rows.groupBy(*doc_keys(rows))
        .agg(
            F.count_if("done").alias("done_rows"),
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if("missing").alias("missing_rows"),
            F.count_if("write_failed").alias("write_failed_rows"),
        )
        .withColumn("percent", F.floor(done / total * 100 + 0.5).cast("bigint"))
        .withColumn("remaining_rows", total - done)
    )


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows still to do: all but those listed in ``done``."""
    keys = row_keys(rows)
    return rows.join(done.select(*keys), keys, "left_anti")


def resume_point(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Per sheet: number of pending rows and the one-based first of them."""
    left = pending(rows, done)
    return left.groupBy(*doc_keys(left)).agg(
        F.count(F.lit(1)).alias("pending_rows"), (F.min("row_idx") + 1).alias("resume_row")
    )


def sheet_profile(cells: DataFrame) -> DataFrame:
    """Row and column extent per sheet."""
    return cells.groupBy(*doc_keys(cells)).agg(
        (F.max("row_idx") - F.min("row_idx") + 1).alias("n_rows"),
        (F.max("col_idx") - F.min("col_idx") + 1).alias("n_cols"),
    )


def issue_list(issues: DataFrame) -> DataFrame:
    """All issues, numbered by ``pos`` from 1 in sheet order within their type."""
    return running(issues, ["type"], _sheet_order(issues), {"pos": F.lit(1)}).withColumn("pos", F.col("pos") + 1)


def issue_samples(issues: DataFrame, n: int) -> DataFrame:
    """The first ``n`` issues of each type in sheet order."""
    return first_n(issues, ["type"], _sheet_order(issues), n)


def _sheet_order(issues: DataFrame) -> list[str]:
    return [*row_keys(issues), "col_idx" if "col_idx" in issues.columns else "col_key"]


def latest_rows(cells: DataFrame, n: int) -> DataFrame:
    """Cells of the last ``n`` rows of each sheet with a ``changed`` flag; ``pos`` 1 is newest."""
    keys, docs = row_keys(cells), doc_keys(cells)
    newest = first_n(cells.select(*keys).distinct(), docs, [F.desc("row_idx")], n)
    return cells.join(newest, keys).withColumn("changed", changed(F.col("original"), F.col("translated")))
