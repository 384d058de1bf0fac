"""Cell and row classification over ``cells`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import is_target_language, is_untranslated, should_translate
from ..functions.script import is_locked, is_neutral
from ..functions.text import has_text, js_trim
from ..schema import cell_keys, row_keys, text_of


def needs_translation(df: DataFrame, side: str, lang: str) -> Column:
    text = text_of(df, side)
    return F.coalesce(has_text(text) & ~is_target_language(text, lang), F.lit(False))


def rows_needing_translation(cells: DataFrame, lang: str, side: str = "original") -> DataFrame:
    """Every row with ``needs_translation``: has it a text outside the target language?

    Neither locks nor identifiers are exempt here, unlike in ``untranslated_cells``.
    """
    flag = needs_translation(cells, side, lang)
    return cells.groupBy(*row_keys(cells)).agg(F.bool_or(flag).alias("needs_translation"))


def wide_needs_translation(wide: DataFrame, columns: list[str], lang: str) -> Column:
    """The same test on one-column-per-header rows: no reshaping, no shuffle."""
    flag = F.lit(False)
    for name in columns:
        flag = flag | F.coalesce(
            has_text(wide[name]) & ~is_target_language(wide[name], lang), F.lit(False)
        )
    return flag


def untranslated_cells(cells: DataFrame, lang: str, side: str = "translated") -> DataFrame:
    """Cells whose text is not in the target language: keys and the trimmed ``value``."""
    text = text_of(cells, side)
    extra = [c for c in ("col_idx",) if c in cells.columns]
    return cells.filter(is_untranslated(F.col("col_key"), text, lang)).select(
        *cell_keys(cells), *extra, js_trim(F.col(side)).alias("value")
    )


def summarize_untranslated(
    cells: DataFrame, lang: str, side: str = "translated"
) -> DataFrame:
    """One row: ``cells`` and distinct ``rows`` that are untranslated.

    Rows are counted by grouping, not by collecting them: the combined counts of one row are
    all that is shuffled.
    """
    found = untranslated_cells(cells, lang, side)
    return (
        found.groupBy(*row_keys(found))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("rows"))
    )


def untranslated_rows(cells: DataFrame, lang: str, side: str = "translated") -> DataFrame:
    """The row list of the summary, as rows."""
    found = untranslated_cells(cells, lang, side)
    return found.select(*row_keys(found)).distinct()


def retryable_cells(cells: DataFrame, lang: str) -> DataFrame:
    """Untranslated cells worth sending again: the current text is not blank, neutral or locked.

    The lock is judged on the original. Both texts sit on the same ``cells`` row, so this is
    one filter. Emits the keys and the ``value`` to send.
    """
    original, current = text_of(cells, "original"), text_of(cells, "translated")
    value = F.coalesce(current, original)
    keep = (
        is_untranslated(F.col("col_key"), current, lang)
        & has_text(value)
        & ~is_locked(F.col("col_key"), F.coalesce(original, value))
        & ~is_neutral(value)
    )
    return cells.filter(F.coalesce(keep, F.lit(False))).select(
        *cell_keys(cells), value.alias("value")
    )


def retryable_summary(cells: DataFrame, lang: str) -> DataFrame:
    found = retryable_cells(cells, lang)
    return (
        found.groupBy(*row_keys(found))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("rows"))
    )


def audit_units(units: DataFrame, lang: str, value: str = "value") -> DataFrame:
    """Text units that are not in the target language."""
    return units.filter(~F.coalesce(is_target_language(F.col(value), lang), F.lit(True)))


def refresh_write_failed(
    failed_rows: DataFrame, cells: DataFrame, lang: str, side: str = "translated"
) -> DataFrame:
    """Write-failed rows that still hold an untranslated cell, each once."""
    keys = row_keys(failed_rows)
    left = failed_rows.select(*keys).distinct()
    return left.join(untranslated_rows(cells, lang, side), keys, "left_semi")


def changed(original: Column, translated: Column) -> Column:
    """Do the trimmed texts differ? A missing value differs from any text."""
    return ~js_trim(original).eqNullSafe(js_trim(translated))


def changed_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(changed(F.col("original"), F.col("translated")))


def pending_cells(cells: DataFrame, lang: str, mode: str) -> Column:
    """Original cells that go to a model: a string, not blank, not locked, to be translated."""
    text = text_of(cells, "original")
    return ~is_locked(F.col("col_key"), text) & should_translate(text, mode, lang)

