"""Progress that is saved while batches of a stream arrive.

``foreachBatch`` may run a batch again after a failure. Each batch is therefore saved under its
number: the store takes a number once, and the running figures are sums over saves that counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.progress import commits, save_progress

FIGURES = ("total", "done", "missing", "write_failed")


def batch_saver(path: str, name: str, to_rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that saves ``to_rows(batch)`` at ``path`` and adds up its figures.

    ``name`` tells streams apart that share a store. Figures are written before the save's commit, under the
    batch's number; those of a run that did not come to its commit are written again.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = to_rows(batch)
        key = f"{name}/{number}"
        flags = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in FIGURES[1:]]
        figures = rows.groupBy("file_id", "target_lang").agg(F.count(F.lit(1)).alias("total"), *flags)
        if not commits(rows.sparkSession, path).where(F.col("save_key") == key).isEmpty():
            return
        stamped = figures.withColumn("save_key", F.lit(key))
        stamped.coalesce(1).write.mode("overwrite").parquet(f"{path}/figures/{name}-{number}")
        save_progress(rows, path, key)

    return save


def running_figures(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, target_lang, total, done, missing, write_failed`` over all batches that counted."""
    figures = spark.read.parquet(f"{path}/figures/*")
    counted = figures.join(commits(spark, path).select("save_key").distinct(), "save_key", "left_semi")
    return counted.groupBy("file_id", "target_lang").agg(*(F.sum(c).alias(c) for c in FIGURES))


def run_progress(stream: DataFrame, to_rows: Callable[[DataFrame], DataFrame], path: str, name: str, checkpoint: str) -> None:
    """Save all that has arrived since the last call, and return."""
    query = (
        stream.writeStream.foreachBatch(batch_saver(path, name, to_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
