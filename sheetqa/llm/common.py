"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let

# ASCII white space; words are maximal runs of everything else.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def word_list(text: Column) -> Column:
    """Words of a text in order, empty ones left out; of NULL: no words."""
    split = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return F.filter(split, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long, without a lambda per word: cut pieces less the empty ends."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return let(
        pieces,
        lambda p: F.size(p)
        - F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == ""), 1).otherwise(0),
    ).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of NULL as of the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def running_before(
    df: DataFrame,
    group: str,
    position: str,
    ties: Sequence[str],
    value: Column,
    out: str,
    bits: int = 12,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come earlier.

    Rows are ordered by ``position``, a 64-bit hash, read as unsigned number, then by ``ties``.
    The hash spreads a group of any size evenly over ``2 ** bits`` blocks: sums inside a block
    take a small window, sums before a block come from the blocks' totals, at most
    ``2 ** bits`` rows per group. ``group`` must not be NULL. ``df`` is read twice, or once if
    ``narrow`` has the same rows with the columns that the sums need.
    """

    def blocked(rows: DataFrame) -> DataFrame:
        block = F.shiftrightunsigned(position, 64 - bits)
        return rows.withColumn("_block", block).withColumn("_value", value)

    rows = blocked(df)
    earlier = Window.unboundedPreceding, -1
    starts = (
        blocked(df if narrow is None else narrow).groupBy(group, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .select(
            group,
            "_block",
            F.coalesce(
                F.sum("_sum").over(Window.partitionBy(group).orderBy("_block").rowsBetween(*earlier)),
                F.lit(0),
            ).alias("_start"),
        )
    )
    inside = Window.partitionBy(group, "_block").orderBy(position, *ties).rowsBetween(*earlier)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, [group, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_inside")).cast("long"))
        .select(*df.columns, out)
    )


def about(df: DataFrame, key: Column, rows: int, seed: int) -> DataFrame:
    """A repeatable sample of at most ``rows`` rows in expectation, chosen by a hash of ``key``.

    One count, then a filter: no task or driver sees more than the sample.
    """
    share = min(1.0, rows / max(1, df.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) * F.lit(2.0**-53)
    return df.where(draw < share)


#: Bits of the filter that tells which hashes may be among given ones.
FILTER_BITS = 23


def hash_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row: ``2 ** bits`` bits as ``array<long>``, set where one of ``hashes`` (one column of long) falls.

    The size is fixed, whatever the number of hashes; more of them only let more others through.
    Made by one aggregation in two steps; used as a scalar subquery.
    """
    (name,) = hashes.columns
    slot = F.col(name).bitwiseAND((1 << bits) - 1)
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
    words = hashes.where(F.col(name).isNotNull()).groupBy(word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask")
    )
    # In blocks, so that no list of all words is searched for one of them.
    blocks = words.groupBy(F.shiftright("word", 8).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(255), "mask"))).alias("of")
    )
    filled = blocks.select(
        "block",
        F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("of", i.cast("long")), F.lit(0).cast("long"))).alias("masks"),
    )
    packed = filled.agg(F.map_from_entries(F.collect_list(F.struct("block", "masks"))).alias("of"))
    none = F.array_repeat(F.lit(0).cast("long"), 256)
    return packed.select(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit((1 << (bits - 14)) - 1)), lambda i: F.coalesce(F.try_element_at("of", i.cast("long")), none)
            )
        ).alias("filter")
    )


def may_be_among(value: Column, table: Column, bits: int = FILTER_BITS) -> Column:
    """False only for hashes that are not among those of the ``hash_filter`` in ``table``."""
    slot = value.bitwiseAND((1 << bits) - 1)
    mask = F.get(table, F.shiftright(slot, 6).cast("int"))
    return mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))) != 0


def long_hashes(*columns: Column) -> tuple[Column, Column]:
    """128 bits of the values as two longs; NULL differs from every value."""
    marked = [x for c in columns for x in (c, c.isNull())]
    return F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)
