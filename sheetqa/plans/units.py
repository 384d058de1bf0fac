"""Text units of documents: masked, sent in batches, merged and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators.merge import merge_units, unit_payload
from ..sources.responses import parse_responses
from ..store import written


def prepare_units(units: DataFrame, lang: str, mode: str = "full", size: int = B.UNIT_BATCH) -> DataFrame:
    """Request batches of ``units(row_idx, value)``: tokens are masked before the batching."""
    sent = unit_payload(units, lang, mode).select("row_idx", F.lit("content").alias("col_key"), "sanitized")
    return B.make_request_batches(sent, size, align=False)


def finish_units(units: DataFrame, batches: DataFrame, responses: DataFrame) -> DataFrame:
    """``units`` with ``merged``; units without a usable answer are polished from their source."""
    checked = written(
        B.validate_responses(batches, parse_responses(responses), ["batch_id"]), "unit-answers"
    )
    answers = B.answer_cells(checked).filter("col_key = 'content'")
    return merge_units(units, answers.select("row_idx", "answer"), "row_idx")
