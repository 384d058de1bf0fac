"""Translation history: an append-only table and its text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranking import running
from .string_resources import STRING_LANGS

SCHEMA = "id string, created_at bigint, source string, outputs map<string,string>"
SEPARATOR = "=" * 80


def append_history(entries: DataFrame, path: str) -> None:
    columns = ["id", "created_at", "source", "outputs"]
    entries.select(*columns).write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def clear_history(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


def number_entries(history: DataFrame) -> DataFrame:
    """Add ``record_no`` from 1 by ``(created_at, id)``; no task sees more than its partition."""
    numbered = running(history, [], ["created_at", "id"], {"record_no": F.lit(1)})
    return numbered.withColumn("record_no", F.col("record_no") + 1)


def _record_text(zone: str) -> Column:
    stamp = F.date_format(
        F.from_utc_timestamp(F.timestamp_millis("created_at"), zone), "yyyy-MM-dd HH:mm:ss"
    )
    parts = [
        F.concat(F.lit("Record "), F.col("record_no").cast("string")),
        F.concat(F.lit("Timestamp: "), stamp),
        F.lit(""),
        F.lit("[Original]"),
        F.coalesce("source", F.lit("")),
    ]
    for lang in STRING_LANGS:
        output = F.coalesce(F.try_element_at("outputs", F.lit(lang)), F.lit(""))
        parts += [F.lit(""), F.lit(f"[{lang}]"), output]
    return F.array_join(F.array(*parts), "\n")


def export_history(history: DataFrame, zone: str = "UTC") -> DataFrame:
    """``(record_no, text)``: each record with the separator that precedes it.

    In order of ``record_no`` the texts make up the export; ``write_history_text`` stores it.
    """
    text = _record_text(zone)
    first = F.col("record_no") == 1
    return number_entries(history).select(
        "record_no", F.when(first, text).otherwise(F.concat(F.lit(SEPARATOR + "\n"), text)).alias("text")
    )


def write_history_text(export: DataFrame, path: str) -> None:
    """Text files whose parts, in name order, hold the records in order."""
    export.orderBy("record_no").select("text").write.mode("overwrite").text(path)
