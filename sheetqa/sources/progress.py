"""Progress snapshots per file and target language, in an append-only store.

A save writes one segment: its rows in a fixed number of hash buckets, and one small row for each
(file, language) pair it replaces. A commit row, written last, makes the segment count; a save
that is interrupted before leaves no trace in what is read. Of each pair the newest segment
counts, clearing adds tombstones, and compaction writes all that counts as one segment that
stands for those before it. Nothing is ever changed in place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["file_id", "target_lang"]
# ``record`` is the row as JSON, so that sheets with different headers share one table.
SCHEMA = (
    "row_idx bigint, record string, done boolean, missing boolean, write_failed boolean, "
    "updated_at bigint, file_id string, target_lang string"
)
BUCKETS = 16
BLOCK_ROWS = 1_000_000

_PAIRS = "file_id string, target_lang string, cleared boolean, segment string, version long, bucket int"
_COMMITS = "version long, segment string, save_key string, base boolean, has_rows boolean"


def _bucket(file_id: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(BUCKETS)).cast("int")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished save: ``version, segment, save_key, base, has_rows``; none where nothing was saved."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def _next(spark: SparkSession, path: str) -> tuple[int, str]:
    version = (commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    return version, f"{version:012d}-{uuid.uuid4().hex}"


def _commit(
    spark: SparkSession, path: str, version: int, segment: str, key: str | None = None, base: bool = False, has_rows: bool = True
) -> None:
    row = spark.createDataFrame([(version, segment, key, base, has_rows)], _COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _write_pairs(pairs: DataFrame, path: str, version: int, segment: str) -> None:
    stamped = pairs.select(
        *KEYS, "cleared", F.lit(segment).alias("segment"), F.lit(version).cast("long").alias("version"), _bucket(F.col("file_id")).alias("bucket")
    )
    stamped.coalesce(1).write.parquet(f"{path}/pairs/{segment}")


def save_progress(rows: DataFrame, path: str, key: str | None = None, base: bool = False) -> bool:
    """Replace the snapshots of the (file, language) pairs in ``rows``; others stay.

    ``rows(file_id, target_lang, row_idx, record, …)``. Flags may be absent, as in older snapshots. A
    save writes at most one file for each bucket and language and every ``BLOCK_ROWS`` rows of it,
    however many files there are. A ``key`` names the save: one that has been saved already is
    not saved again, and False comes back.
    """
    spark = rows.sparkSession
    if key is not None and not commits(spark, path).where(F.col("save_key") == key).isEmpty():
        return False
    version, segment = _next(spark, path)
    stamped = rows
    if "updated_at" not in rows.columns:
        stamped = rows.withColumn("updated_at", F.unix_millis(F.current_timestamp()))
    known = [c.split()[0] for c in SCHEMA.split(", ")]
    stamped = stamped.select(*[c for c in known if c in stamped.columns], _bucket(F.col("file_id")).alias("bucket"))
    (
        stamped.repartition("bucket", "target_lang", F.expr(f"row_idx div {BLOCK_ROWS}"))
        .sortWithinPartitions("bucket", *KEYS[::-1], "row_idx")
        .write.partitionBy("bucket", "target_lang")
        .parquet(f"{path}/rows/{segment}")
    )
    # The pairs of what was written, not of ``rows``: these may differ if they are made again.
    pairs = _segment_rows(spark, path, [segment]).select(*KEYS).distinct().withColumn("cleared", F.lit(False))
    _write_pairs(pairs, path, version, segment)
    _commit(spark, path, version, segment, key, base)
    return True


def clear_progress(
    spark: SparkSession, path: str, file_id: str, target_lang: str | None = None
) -> None:
    """Remove one (file, language) snapshot, or all of a file, by a tombstone."""
    version, segment = _next(spark, path)
    pair = spark.createDataFrame([(file_id, target_lang, True)], "file_id string, target_lang string, cleared boolean")
    _write_pairs(pair, path, version, segment)
    _commit(spark, path, version, segment, has_rows=False)


def _segment_rows(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    """Rows of these segments, with ``segment`` and ``bucket``."""
    rows = spark.createDataFrame([], SCHEMA + ", bucket int, segment string")
    for segment in segments:
        part = spark.read.schema(SCHEMA + ", bucket int").parquet(f"{path}/rows/{segment}")
        rows = rows.unionByName(part.withColumn("segment", F.lit(segment)))
    return rows


def _current(spark: SparkSession, path: str) -> list:
    """Commits that count: those since the last compaction, oldest first; compaction keeps them few."""
    known = sorted(commits(spark, path).collect(), key=lambda row: (row["version"], row["segment"]))
    start = max((i for i, row in enumerate(known) if row["base"]), default=0)
    return known[start:]


def load_progress(
    spark: SparkSession, path: str, file_id: str | None = None, target_lang: str | None = None
) -> DataFrame:
    """Snapshots of one pair, one file or all; the filters prune buckets and languages.

    A snapshot without flags counts every stored row as done.
    """
    current = _current(spark, path)
    rows = _segment_rows(spark, path, [c["segment"] for c in current if c["has_rows"]])
    pairs = (
        spark.read.schema(_PAIRS).parquet(*(f"{path}/pairs/{c['segment']}" for c in current))
        if current
        else spark.createDataFrame([], _PAIRS)
    )
    if file_id is not None:
        rows, pairs = (t.where((F.col("bucket") == _bucket(F.lit(file_id))) & (F.col("file_id") == file_id)) for t in (rows, pairs))
    if target_lang is not None:
        rows = rows.where(F.col("target_lang") == target_lang)
        pairs = pairs.where("target_lang is null").unionByName(pairs.where(F.col("target_lang") == target_lang))
    age = F.struct("version", "segment")
    newest = pairs.where("target_lang is not null").groupBy(*KEYS).agg(
        F.max(F.struct(age.alias("age"), "cleared")).alias("last")
    )
    whole = pairs.where("target_lang is null and cleared").groupBy("file_id").agg(F.max(age).alias("gone"))
    counts = newest.join(whole, "file_id", "left").where(
        ~F.col("last.cleared") & (F.col("gone").isNull() | (F.col("last.age") > F.col("gone")))
    )
    counts = counts.select(*KEYS, F.col("last.age.segment").alias("segment"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    defaults = {"done": True, "missing": False, "write_failed": False}
    return (
        rows.join(counts, [*KEYS, "segment"], "left_semi")
        .select(*names)
        .withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()})
    )


def compact_progress(spark: SparkSession, path: str) -> None:
    """Write all that counts as one segment, which readers use instead of those before it.

    Older segments stay on disk, unread, for readers that are under way.
    """
    save_progress(load_progress(spark, path), path, base=True)


def with_progress(data_rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All rows of a file with the snapshot's flags; rows it lacks are not done."""
    keys = ["row_idx"]
    flags = ["done", "missing", "write_failed"]
    joined = data_rows.join(snapshot.select(*keys, *flags), keys, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in flags})
