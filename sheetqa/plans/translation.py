"""Sheet translation: cells to requests, answers to finished cells.

The model call lies between the two halves, outside Spark: write ``batches``, have them
answered, read the answers as a table ``(batch_id, text)`` and finish.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.polish import polish
from ..operators import batches as B
from ..operators.classify import retryable_cells, rows_needing_translation
from ..operators.merge import (
    merge_retries,
    merge_translations,
    retried_status,
    retry_payload,
    row_status,
)
from ..operators.quality import pending
from ..operators.splits import resolve_splits
from ..schema import cell_keys, doc_keys, row_keys
from ..sources.reshape import write_back
from ..sources.responses import parse_responses
from ..store import written


class Finished(NamedTuple):
    cells: DataFrame
    status: DataFrame


def prepare(
    cells: DataFrame,
    lang: str,
    mode: str = "full",
    done: DataFrame | None = None,
    size: int = B.SHEET_BATCH,
) -> DataFrame:
    """Request batches of the rows still to do.

    Rows listed in ``done`` are left out; in selective mode also those in the target language.
    """
    rows = rows_needing_translation(cells, lang)
    if mode == "selective":
        rows = rows.filter("needs_translation")
    rows = rows.select(*row_keys(cells))
    if done is not None:
        rows = pending(rows, done)
    if mode == "selective" or done is not None:
        return B.pending_requests(cells, rows, lang, mode, size)
    return B.make_request_batches(B.sanitize_cells(cells, lang, mode), size, align=True)


def _checked(batches: DataFrame, responses: DataFrame, by: list[str]) -> DataFrame:
    numbered = dict(batches.dtypes)["batch_id"] != "string"
    if numbered and dict(responses.dtypes)["batch_id"] == "string":
        return resolve_splits(batches, responses, by)
    return B.validate_responses(batches, parse_responses(responses), by)


def finish(
    cells: DataFrame, batches: DataFrame, responses: DataFrame, lang: str, mode: str = "full"
) -> Finished:
    """Merge raw answers ``(doc keys, batch_id, text)`` and derive each row's status.

    Batches with unusable answers leave their rows as they were and mark them write-failed. A
    batch may be answered any number of times: ``attempt`` and ``arrived`` tell which valid answer is
    the newest, and all its cells come from that one. Ids given as strings may be paths of split
    batches (``splits``); a batch is then answered by its leaves.
    """
    by = [*doc_keys(batches), "batch_id"]
    # Both results need the parsed answers and the merged cells: written once, not made twice.
    checked = written(_checked(batches, responses, by), "answers")
    merged = written(merge_translations(cells, B.answer_cells(checked), lang, mode), "merged")
    return Finished(merged, row_status(merged, lang, mode, B.row_outcome(checked)))


def prepare_retry(cells: DataFrame, lang: str, size: int = B.RETRY_BATCH) -> DataFrame:
    """Request batches of the cells that an audit of ``translated`` finds worth sending again."""
    sent = retry_payload(cells, retryable_cells(cells, lang))
    return B.make_request_batches(sent, size, align=False)


def finish_retry(
    cells: DataFrame, batches: DataFrame, responses: DataFrame, status: DataFrame, lang: str
) -> Finished:
    """Merge retry answers on top of ``translated`` and refresh the flags of ``status``.

    Rows whose batch was answered count as done; a row stays write-failed only while something
    in it is untranslated. A failed batch leaves its rows as they were.
    """
    by = [*doc_keys(batches), "batch_id"]
    checked = written(_checked(batches, responses, by), "answers")
    answers = B.answer_cells(checked)
    merged = written(merge_retries(cells, answers, answers), "merged")
    retried = B.row_outcome(checked).filter("ok")
    return Finished(merged, retried_status(merged, retried, status, lang))


def export_sheet(base: DataFrame, cells: DataFrame) -> DataFrame:
    """Finished cells into the sheet: polished once more, formulas overwritten.

    ``base`` as for ``write_back``; ``cells`` have ``original`` and ``translated``.
    """
    original = F.coalesce(F.col("original"), F.lit(""))
    value = polish(original, F.col("translated"))
    return write_back(base, cells.select(*cell_keys(cells), value.alias("value")), overwrite_formulas=True)
