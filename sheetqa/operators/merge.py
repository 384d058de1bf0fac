"""Putting answers back into tables: merge, retry, repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glossary import GLOSSARY, GlossaryEntry
from ..functions.language import is_untranslated, should_translate
from ..functions.masking import (
    mask_inline,
    mask_string,
    mask_translation,
    restore,
    restore_tolerant,
)
from ..functions.polish import polish, string_autofix
from ..functions.quality import spacing_issue
from ..functions.script import is_locked, is_neutral
from ..functions.text import has_text, let
from ..schema import cell_keys, row_keys, text_of
from .answers import VERSION, newest
from .classify import needs_translation, pending_cells


def _text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def postprocess_cells(
    cells: DataFrame, glossary: Sequence[GlossaryEntry] = GLOSSARY
) -> DataFrame:
    """Polish every translated text unless its cell is locked.

    The lock looks at the original where that is a string, else at the translation. Tokens
    are already restored at this point, so an identifier inside a sentence may be split; the
    step is therefore its own call and never run twice silently.
    """
    original, text = text_of(cells, "original"), text_of(cells, "translated")
    locked = is_locked(F.col("col_key"), F.coalesce(original, text))
    polished = polish(_text_or_empty(original), F.col("translated"), glossary)
    return cells.withColumn(
        "translated",
        F.when(text.isNotNull() & ~locked, polished).otherwise(F.col("translated")),
    )


def apply_quality_fixes(
    cells: DataFrame, glossary: Sequence[GlossaryEntry] = GLOSSARY
) -> DataFrame:
    """``postprocess_cells``, locked originals put back, remaining spacing issues polished again."""
    fixed = postprocess_cells(cells, glossary)
    original, text = text_of(fixed, "original"), text_of(fixed, "translated")
    again = polish(_text_or_empty(original), F.col("translated"), glossary)
    return fixed.withColumn(
        "translated",
        F.when(is_locked(F.col("col_key"), original), F.col("original"))
        .when(F.coalesce(spacing_issue(text), F.lit(False)), again)
        .otherwise(F.col("translated")),
    )


def _polish_restore(
    source: Column, answer: Column, masked: Column, glossary: Sequence[GlossaryEntry]
) -> Column:
    """Polish an answer, then put back the tokens masked in ``masked``.

    Masking is deterministic, so the placeholders are derived again from the text that was
    sent: no placeholder table has to be stored or joined.
    """
    return let(
        polish(source, answer, glossary),
        lambda text: F.when(
            text.contains("__"), restore(text, mask_translation(masked)["pairs"])
        ).otherwise(text),
    )


def _with_answers(cells: DataFrame, answers: DataFrame) -> DataFrame:
    """Left-join ``answers(keys, answer)``; a missing answer is NULL.

    A key that is answered twice counts once, by its newest answer, so no cell is multiplied.
    Answers are unpacked from small files, whose size says nothing about their rows: the join is
    never one that sends them to the driver. So it is with the other joins of answers here.
    """
    return cells.join(_once(answers, cell_keys(cells)).hint("merge"), cell_keys(cells), "left")


def _once(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, answer``: the newest answer that is not NULL for each key."""
    known = answers.where("answer is not null")
    return newest(known.select(*keys, *(c for c in ("answer", *VERSION) if c in known.columns)), keys).select(*keys, "answer")


def merge_translations(
    cells: DataFrame,
    answers: DataFrame,
    lang: str,
    mode: str = "full",
    glossary: Sequence[GlossaryEntry] = GLOSSARY,
) -> DataFrame:
    """``cells`` with ``translated`` from ``answers(keys, answer)``.

    No answer, a locked or a not translatable cell keeps its original; an answer is
    polished and its tokens are restored.
    """
    joined = _with_answers(cells, answers)
    original = text_of(joined, "original")
    use = F.col("answer").isNotNull() & pending_cells(joined, lang, mode)
    merged = _polish_restore(original, F.col("answer"), original, glossary)
    return joined.withColumn(
        "translated", F.when(use, merged).otherwise(F.col("original"))
    ).drop("answer")


def row_status(
    merged: DataFrame, lang: str, mode: str = "full", outcome: DataFrame | None = None
) -> DataFrame:
    """Per row: ``done``, ``missing`` (still untranslated), ``write_failed``.

    ``outcome(row keys, ok)`` says of each row that was sent whether its batch succeeded; NULL
    means every row was answered. An answered row is done when nothing in it is
    untranslated; one that was not sent is done only in selective mode, when it needed nothing.
    """
    keys = row_keys(merged)
    rows = merged.groupBy(*keys).agg(
        F.bool_or(
            is_untranslated(F.col("col_key"), text_of(merged, "translated"), lang)
        ).alias("missing"),
        F.bool_or(needs_translation(merged, "original", lang)).alias("_needs"),
    )
    if outcome is None:
        rows = rows.withColumn("ok", F.lit(True))
    else:
        rows = rows.join(outcome.select(*keys, "ok").hint("merge"), keys, "left")
    unsent = ~F.col("_needs") if mode == "selective" else F.lit(False)
    done = F.when(F.col("ok"), ~F.col("missing")).when(~F.col("ok"), False).otherwise(unsent)
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    return rows.select(*keys, done.alias("done"), "missing", failed.alias("write_failed"))


def retry_source(cells: DataFrame) -> Column:
    """The text a retry sends: the current translation, else the original."""
    return F.coalesce(text_of(cells, "translated"), text_of(cells, "original"))


def retry_payload(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Cells to send again for ``keys``, with the masked text as ``sanitized``."""
    on = cell_keys(cells)
    picked = cells.join(keys.select(*on).distinct().hint("merge"), on, "left_semi")
    value = retry_source(picked)
    lock = F.coalesce(text_of(picked, "original"), value)
    send = has_text(value) & ~is_locked(F.col("col_key"), lock) & ~is_neutral(value)
    return picked.filter(F.coalesce(send, F.lit(False))).withColumn(
        "sanitized", mask_translation(value)["sanitized"]
    )


def merge_retries(
    cells: DataFrame,
    answers: DataFrame,
    keys: DataFrame,
    glossary: Sequence[GlossaryEntry] = GLOSSARY,
) -> DataFrame:
    """Answers to retried ``keys`` on top of the current translation.

    Polishes against the *current* text, which is also what was sent. ``row_status`` over
    the result gives the new flags.
    """
    on = cell_keys(cells)
    wanted = answers.join(keys.select(*on).distinct().hint("merge"), on, "left_semi")
    joined = _with_answers(cells, wanted)
    source = retry_source(joined)
    lock = F.coalesce(text_of(joined, "original"), source, F.lit(""))
    use = F.col("answer").isNotNull() & ~is_locked(F.col("col_key"), lock)
    merged = _polish_restore(_text_or_empty(source), F.col("answer"), source, glossary)
    return joined.withColumn(
        "translated", F.when(use, merged).otherwise(F.col("translated"))
    ).drop("answer")


def retry_cells(
    cells: DataFrame,
    answers: DataFrame,
    keys: DataFrame,
    lang: str,
    mode: str = "full",
    glossary: Sequence[GlossaryEntry] = GLOSSARY,
) -> DataFrame:
    """Answers to ``keys`` sent from the *original* text (placeholder leaks)."""
    on = cell_keys(cells)
    wanted = answers.join(keys.select(*on).distinct().hint("merge"), on, "left_semi")
    joined = _with_answers(cells, wanted)
    original = text_of(joined, "original")
    use = F.col("answer").isNotNull() & pending_cells(joined, lang, mode)
    merged = _polish_restore(original, F.col("answer"), original, glossary)
    return joined.withColumn(
        "translated", F.when(use, merged).otherwise(F.col("translated"))
    ).drop("answer")


def retried_status(
    cells: DataFrame, retried_rows: DataFrame, status: DataFrame, lang: str
) -> DataFrame:
    """Row flags after ``retry_cells``: retried rows are done, then the missing set is refreshed."""
    keys = row_keys(cells)
    missing = cells.groupBy(*keys).agg(
        F.bool_or(
            is_untranslated(F.col("col_key"), text_of(cells, "translated"), lang)
        ).alias("missing")
    )
    retried = retried_rows.select(*keys).distinct().withColumn("_retried", F.lit(True))
    return (
        status.select(*keys, "done", "write_failed")
        .join(missing.hint("merge"), keys, "left")
        .join(retried.hint("merge"), keys, "left")
        .select(
            *keys,
            (F.col("done") | F.coalesce(F.col("_retried"), F.lit(False))).alias("done"),
            F.coalesce(F.col("missing"), F.lit(False)).alias("missing"),
            (F.col("write_failed") & F.coalesce(F.col("missing"), F.lit(False))).alias(
                "write_failed"
            ),
        )
    )


def unit_payload(units: DataFrame, lang: str, mode: str = "full") -> DataFrame:
    """Text units to send, with their masked text."""
    return units.filter(should_translate(F.col("value"), mode, lang)).withColumn(
        "sanitized", mask_inline(F.col("value"))["sanitized"]
    )


def merge_units(
    units: DataFrame,
    answers: DataFrame,
    key: str = "unit_id",
    glossary: Sequence[GlossaryEntry] = GLOSSARY,
) -> DataFrame:
    """Text units: tokens restored first, then polished. No answer: the source is used.

    Of several answers the newest counts, so units keep their number.
    """
    joined = units.join(_once(answers, [key]).hint("merge"), key, "left")
    source = _text_or_empty(F.col("value"))
    restored = restore(
        F.coalesce(F.col("answer"), F.col("value")), mask_inline(F.col("value"))["pairs"]
    )
    sent = units.columns
    return joined.withColumn(
        "merged", let(restored, lambda text: polish(source, text, glossary))
    ).select(*sent, "merged")


def merge_string_lines(
    entries: DataFrame,
    answers: DataFrame,
    key: str | list[str] = "line_no",
    autofix: bool = True,
    compat: bool = False,
    glossary: Sequence[GlossaryEntry] = GLOSSARY,
) -> DataFrame:
    """Resource lines: restore, repair spacing, polish, put prefix and suffix back.

    ``entries`` come from ``parse_string_lines``. Lines that need no translation stay as they
    are; a line without an answer is polished from its own content. Adds ``merged``. Of several
    answers to a line the newest counts, so lines keep their number.
    """
    keys = [key] if isinstance(key, str) else key
    joined = entries.join(_once(answers, keys).hint("merge"), keys, "left")
    content = F.col("content")
    text = restore_tolerant(
        F.coalesce(F.col("answer"), content), mask_string(content)["pairs"], compat
    )

    def finish(t: Column) -> Column:
        return polish(content, t, glossary)

    polished = let(text, lambda t: let(string_autofix(t), finish) if autofix else finish(t))
    line = F.concat(F.col("prefix"), polished, F.col("suffix"))
    return joined.withColumn(
        "merged", F.when(F.col("needs_translation"), line).otherwise(F.col("line"))
    ).drop("answer")
