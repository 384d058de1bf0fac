"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written
from .common import running_before, word_count, word_list

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20240501


def source_sizes(sized: DataFrame) -> DataFrame:
    """``source, source_size, _position``: words per source; positions by code point, NULL last.

    The sources are sorted by range partitions and written; then only the partitions' sizes,
    one row for each, meet in one task.
    """
    by_size = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = written(
        by_size.orderBy(F.col("source").asc_nulls_last()).withColumn(
            "_pos", F.monotonically_increasing_id()
        ),
        "sources",
    ).withColumn("_part", F.shiftright("_pos", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    position = F.col("_start") + F.col("_pos").bitwiseAND((1 << 33) - 1)
    return ordered.join(starts, "_part").select("source", "source_size", position.alias("_position"))


def fill(sources: DataFrame, total: int, epochs: int) -> Column:
    """The target of each source as a Column over ``source_size`` and ``weight``.

    A source takes its share by weight of what is left, at most ``epochs`` times its size; the
    excess of capped sources is shared again until no other exceeds its cap. Each round is one
    aggregation over the sources, of which the driver sees three whole numbers.
    """
    cap = F.col("source_size") * epochs
    level = 0.0
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        left, weight, over = sources.agg(
            F.lit(total) - F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.count(F.lit(1)),
        ).first()
        raised = left / weight if weight else level
        if raised <= level:
            break
        level = raised
    return F.least(cap.cast("double"), F.col("weight") * F.lit(level))


def _key(source: Column) -> Column:
    """A source as a key that is never NULL and keeps NULL apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix_documents(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often each row goes into the mix: ``doc_id, source, size, source_size, target, taken``.

    ``size`` counts a text's words (NULL or empty: 0). Sources, in order of code points with NULL
    last, weigh ``weights`` in turn and share the words of all documents; a source without
    words gets target 0. Every row of a source is taken ``floor(target / source_size)`` times
    whole. The words still missing come from its rows in seeded order, each once more; the last
    of these gives only the words needed, so a source's words add up to its target, rounded.
    Repeated rows count as rows of their own, and NULL ids are ids. An empty table gives no rows.
    ``carry`` names columns of ``docs`` to keep as well.
    """
    carry = [c for c in carry if c not in ("doc_id", "source")]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("_text"),
        F.struct(F.lit(0).alias("_"), *carry).alias("_kept"),
        word_count(F.col("text")).alias("size"),
        digest.alias("_md5"),
        _key(F.col("source")).alias("_source"),
        # The digest's first 15 digits, moved to the top of 64 bits: its order, and even blocks.
        F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 4).alias("_order"),
    )
    # Without what is carried, this is narrow; carried columns are read again where they are used.
    sized = written(rows.drop("_kept"), "sized")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wheel = F.array(*map(F.lit, weights))
    sources = written(
        source_sizes(sized).withColumn(
            "weight", F.get(wheel, (F.col("_position") % len(weights)).cast("int")).cast("long")
        ),
        "source-sizes",
    )
    targets = sources.select(
        _key(F.col("source")).alias("_source"), "source_size", fill(sources, total, epochs).alias("target")
    )
    ranked = running_before(
        rows if carry else sized, "_source", "_order", ["_md5", "_text"], F.col("size"), "_before", narrow=sized
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    missing = F.round("target").cast("long") - F.col("_whole") * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), missing - F.col("_before")))
    return (
        ranked.join(targets, "_source")
        .withColumn("_whole", whole)
        .withColumn("taken", (F.col("_whole") * F.col("size") + extra).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", *(f"_kept.{c}" for c in carry))
    )


def repeated(mix: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of ``mix_documents`` as often as it is taken.

    Whole repetitions are rows with the whole text, a fractional one has the first words, with
    single spaces. Rows that are not taken are left out.
    """
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(0).cast("int")
    cut = F.array_join(F.slice(word_list(F.col(text)), F.lit(1), F.col("_part")), " ")
    copies = F.concat(
        F.array_repeat(F.col(text), F.col("_times")),
        F.when(F.col("_part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    return (
        mix.withColumn("_times", times)
        .withColumn("_part", part)
        .withColumn(text, F.explode(copies))
        .drop("_times", "_part")
    )
