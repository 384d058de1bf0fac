"""String-resource translation into several languages at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_string
from ..operators.merge import merge_string_lines
from ..operators.quality import quality_by_lang
from ..sources.string_resources import (
    STRING_LANGS,
    join_string_lines,
    parse_string_lines,
    split_string_lines,
)


def per_language(entries: DataFrame, langs: Sequence[str] = STRING_LANGS) -> DataFrame:
    """Every line once per target language, by exploding the fixed language list."""
    return entries.withColumn("lang", F.explode(F.array(*map(F.lit, langs))))


def resource_requests(texts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, lines to send per language with their ``sanitized`` content)."""
    entries = parse_string_lines(split_string_lines(texts, "text", by))
    sent = per_language(entries.filter("needs_translation"))
    return entries, sent.select(
        *by, "line_no", "lang", mask_string(F.col("content"))["sanitized"].alias("sanitized")
    )


def finish_resources(
    entries: DataFrame, answers: DataFrame, by: list[str]
) -> DataFrame:
    """Translated files ``(by…, lang, block_no, text)`` from ``answers(by…, line_no, lang, answer)``."""
    keys = [*by, "line_no", "lang"]
    merged = merge_string_lines(per_language(entries), answers, keys)
    return join_string_lines(merged, [*by, "lang"], "merged")


def resource_quality(files: DataFrame, by: list[str]) -> DataFrame:
    """Counts per language over the contents of translated files."""
    lines = split_string_lines(files, "text", [*by, "lang"])
    return quality_by_lang(parse_string_lines(lines))
