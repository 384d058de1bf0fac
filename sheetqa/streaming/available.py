"""Stateless operators over files as they arrive.

Cell classification, masking, polishing and the per-cell quality tests keep no state, so the
same Columns run on a stream; no watermark is needed. A pass handles what has arrived since
the last one and stops: the checkpoint remembers what is done, also after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_cells(spark: SparkSession, directory: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(directory)
    )


def run_pass(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> None:
    """Apply ``transform`` to all new input, append to ``out``, and return when it is done."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
