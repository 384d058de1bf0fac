"""String-resource files: lines in, lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.script import has_cjk
from ..functions.text import B_END, WS

# The shape of a resource line and the languages it is translated to.
RESOURCE_LINE = rf"(?s)^([{WS}]*<string{B_END}[^>]*>)(.*)(</string>[{WS}]*)\z"
STRING_LANGS = [
    "English",
    "Spanish",
    "French",
    "German",
    "Italian",
    "Russian",
    "Portuguese",
]


# Lines of a block of text.
BLOCK_LINES = 1000


def split_string_lines(texts: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """A file's text to ``(by…, line_no, line, line_break)``, lines numbered from 0."""
    by = by or []
    line_break = F.when(F.col(text).contains("\r\n"), "\r\n").otherwise("\n")
    # Found once per text: beside the explode it would search the whole text for every line.
    split = texts.select(
        *by, line_break.alias("line_break"), F.split(F.col(text), "\r?\n", -1).alias("_lines")
    )
    return split.select(*by, "line_break", F.posexplode("_lines").alias("line_no", "line"))


def parse_string_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``prefix``, ``content``, ``suffix``, ``needs_translation``.

    Only ``<string …>body</string>`` has a prefix and a suffix; any other line is content.
    """
    c = F.col(line)

    def mark(i: int) -> Column:
        return F.coalesce(F.regexp_extract(c, RESOURCE_LINE, i), F.lit(""))

    return (
        lines.withColumn("prefix", mark(1))
        # The pattern spans the whole line: one search both tests the line and cuts it.
        .withColumn("content", F.regexp_replace(c, RESOURCE_LINE, "$2"))
        .withColumn("suffix", mark(3))
        .withColumn("needs_translation", has_cjk(F.col("content")))
    )


def join_string_lines(
    lines: DataFrame,
    by: list[str] | None = None,
    line: str = "merged",
) -> DataFrame:
    """Lines back to text, as numbered blocks ``(by…, block_no, text)`` of ``BLOCK_LINES`` lines.

    A file's blocks one after the other are the file; a sink that wants one text writes them in
    order. No file is collected into one task, however long it is. Input that ended with a
    line break gets one more: its last, empty line already stands for that break.
    """
    by = by or []
    part = F.expr(f"line_no div {BLOCK_LINES}")
    parts = (
        lines.withColumn("block_no", part)
        .groupBy(*by, "block_no")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", F.col(line).alias("text")))).alias("_lines"),
            F.first("line_break").alias("_break"),
            F.max(F.struct("line_no", "line")).alias("_last"),
        )
    )
    # A file's last line decides on the closing break: a maximum, combined before the shuffle, of
    # numbers alone, which need no sort. Keyed by part it meets one part each, however many parts
    # one file has.
    last = lines.groupBy(*by).agg(F.max("line_no").alias("line_no"))
    ends = last.select(*by, part.alias("block_no"), F.lit(True).alias("_is_last"))
    ends_empty = F.when(F.col("_is_last"), F.col("_last.line") == "")
    texts = F.transform("_lines", lambda x: x["text"])
    body = F.call_function("array_join", texts, F.col("_break"))
    tail = F.when(F.coalesce(ends_empty, F.lit(True)), F.col("_break")).otherwise("")
    return parts.join(ends, [*by, "block_no"], "left").select(
        *by, "block_no", F.concat(body, tail).alias("text")
    )
