"""Quality rules, and a verdict by a log-likelihood ratio of hashed n-grams.

Words, numbers and runs of signs are tokens; a text's n-grams are its tokens and its pairs of
adjacent tokens, hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted:
one from trusted texts, one from all texts. A text's score is the mean over its n-grams of the
logarithm of the ratio of both. Every text is held against the same threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..store import discard, written
from .common import SPACE_CHARS, word_list

BUCKETS = 16_384
#: Share of trusted texts that may lie below the threshold.
TAIL = 0.001
#: Ratios are held against the threshold as whole multiples of 2 ** -_FINE.
_FINE = 40
_DIGIT = 16
SYMBOLS = "#*$%&|<>"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def ngrams(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's tokens and of its pairs of adjacent tokens; NULL counts as empty."""

    def bucket(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets))

    def both(t: Column) -> Column:
        ones = F.transform(t, lambda w: bucket(F.hash(w)))
        pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: bucket(F.hash(F.get(t, i), w)))
        return F.concat(ones, pairs)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0)), both)


#: Rows whose flags go into one row of the table of trusted rows, as a power of two; and those of one number.
_BLOCK, _WORD = 15, 6


def marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows(doc_id, row, …)`` with ``good``: whether the id is in ``trusted`` (one column ``doc_id``, any number of ids).

    Only ids and row numbers (distinct, non-negative) meet the trusted ids. What comes back to the rows is one
    bit for each: a table of a thousandth of their size, so Spark takes it to where the rows are.
    """
    ids = trusted.select("doc_id").where("doc_id is not null")
    found = rows.select("doc_id", "row").where("doc_id is not null").join(ids, "doc_id", "left_semi")
    bit = F.col("row").bitwiseAND((1 << _WORD) - 1).cast("int")
    words = found.groupBy(F.shiftright("row", _WORD).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask")
    )
    last = (1 << (_BLOCK - _WORD)) - 1
    blocks = words.groupBy(F.shiftright("word", _BLOCK - _WORD).alias("_block")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(last).cast("int"), "mask"))).alias("of")
    )
    masks = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long")))
    # Written first, so that its size is known when the join is planned.
    bits = written(blocks.select("_block", masks.alias("_masks")), "trusted-rows")
    mask = F.get("_masks", F.shiftright("row", _WORD).bitwiseAND(last).cast("int"))
    good = mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0
    return (
        rows.withColumn("_block", F.shiftright("row", _BLOCK))
        .join(bits, "_block", "left")
        .select(*rows.columns, F.coalesce(good, F.lit(False)).alias("good"))
    )


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket_ratios`` of all rows of ``docs(doc_id, text)``; those whose id is in ``trusted`` also count as trusted."""
    rows = docs.select("doc_id", ngrams(F.col("text"), buckets).alias("grams"), F.monotonically_increasing_id().alias("row"))
    return bucket_ratios(marked(written(rows, "grams"), trusted), buckets)


def bucket_ratios(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratio``: for each bucket the logarithm of trusted to raw probability.

    Counts cover all of ``rows(grams, good)``; those that are ``good`` also count as trusted. Bucket
    counts start at 1. Grams are added up per task before the shuffle, so that moves ``buckets``
    rows per task; the lists of grams never move.
    """
    counts = rows.select(F.explode("grams").alias("bucket"), "good").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good")
    ).select(F.col("bucket").cast("int").alias("bucket"), "raw", "good")
    # One row of at most ``buckets`` entries, put in order of the bucket.
    packed = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("raw", "good")))).alias("of"),
        (F.coalesce(F.sum("raw"), F.lit(0)) + buckets).alias("raw"),
        (F.coalesce(F.sum("good"), F.lit(0)) + buckets).alias("good"),
    )
    entries = F.array_sort(F.map_entries("of"))
    filled = let(
        F.map_from_entries(entries),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(buckets - 1)),
            lambda b: let(
                F.try_element_at(m, b),
                lambda c: F.log((F.coalesce(c["good"], F.lit(0)) + 1) / F.col("good"))
                - F.log((F.coalesce(c["raw"], F.lit(0)) + 1) / F.col("raw")),
            ),
        ),
    )
    return packed.select(filled.alias("ratio"))


def score(text: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """Mean ratio over a text's n-grams; 0 for a text without any."""
    return let(ngrams(text, buckets), lambda grams: mean_ratio(grams, table))


def mean_ratio(grams: Column, table: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)


def kth_smallest(values: DataFrame, k: int) -> int:
    """The ``k``-th smallest (from 1) of whole numbers below ``2 ** 48``, in one column; exact.

    A histogram per 16 bits, the highest first, each inside the bucket that the one before it
    found. The driver sees at most 65,536 counts at a time.
    """
    (name,) = values.columns
    found = 0
    for shift in (2 * _DIGIT, _DIGIT, 0):
        inside = values.where(F.shiftright(name, shift + _DIGIT) == found)
        digit = F.shiftright(name, shift).bitwiseAND((1 << _DIGIT) - 1)
        for row in sorted(inside.groupBy(digit.alias("digit")).count().collect()):
            if k <= row["count"]:
                break
            k -= row["count"]
        found = found << _DIGIT | row["digit"]
    return found


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first included.

    Windows are hashed, sorted together with their places and compared with their neighbours;
    the places of repeated ones, sorted again, cover three words each, less what they share.
    """

    def from_windows(pairs: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            before = F.get(pairs, i - 1)["h"] == x["h"]
            after = F.get(pairs, i + 1)["h"] == x["h"]
            return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["i"])

        places = F.sort_array(F.array_compact(F.transform(pairs, same)))
        return let(
            places,
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
                lambda acc, i: F.struct(
                    (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")
                ),
            )["n"],
        )

    def from_words(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda c, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), c),
        )

        def from_hashes(h: Column) -> Column:
            placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            # Most texts repeat no window: a set of numbers tells, without the sort.
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
                let(F.sort_array(placed), from_windows)
            )

        return let(hashes, from_hashes)

    return let(words, from_words).cast("long")


def rule_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with the figures of the rules, all as long, and ``base_failed``; NULL counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)

    def figures(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    return (
        docs.withColumn("_figures", let(word_list(text), figures))
        .withColumn("n_words", F.col("_figures.n_words"))
        .withColumn("word_chars", F.length(F.translate(text, SPACE_CHARS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("_figures.n_repeat_words"))
        .drop("_figures")
        .withColumn(
            "base_failed",
            (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        )
    )


def judge(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rules' figures and the verdict of each row of ``docs``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio``.
    Trusted texts are all those labelled of good quality. The threshold is the ``tail`` quantile
    of the ratios of all that pass the rules: the exact value of that rank, whatever the order in which tasks
    end. A row is kept if the rules pass and its ratio reaches the threshold. Without trusted texts, the
    ratio decides nothing. NULL texts count as empty and fail the rules; rows with NULL or repeated
    ids are judged each for itself. Texts are read once, and what is kept of them are their n-grams.
    These lie where they were found until they are scored.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id")
    grams = ngrams(F.col("text")).cast("array<smallint>" if BUCKETS <= 1 << 15 else "array<int>")
    figured = rule_figures(docs.select("doc_id", "text")).withColumn("grams", grams).drop("text")
    stored = written(figured.withColumn("row", F.monotonically_increasing_id()), "figures")
    known = marked(stored, good)
    table = bucket_ratios(known)
    # The table is one row: a scalar subquery, which Spark runs once and hands to the tasks.
    scored = known.withColumn("_table", table.scalar())
    scored = scored.withColumn("ratio", mean_ratio(F.col("grams"), F.col("_table"))).drop("grams", "_table", "row")
    scored = written(scored, "scored")
    discard(stored)
    # Ratios are logarithms of quotients of counts, so far below 2 ** 7.
    place = F.floor(F.col("ratio") * F.lit(2.0**_FINE)).cast("long") + F.lit(1 << 47)
    passing = scored.where(~F.col("base_failed") & F.col("good")).select(place.alias("place"))
    n = passing.count()
    least = kth_smallest(passing, max(1, math.ceil(tail * n))) if n else 0
    return scored.drop("good").withColumn("kept", ~F.col("base_failed") & (place >= F.lit(least)))
