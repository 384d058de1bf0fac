"""Where intermediate and stored tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN.discard(path)


def remove_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; DataFrames over them no longer work."""
    if _WRITTEN:
        _delete(spark, sorted(_WRITTEN))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: fixed rows, short lineage.

    Rows of each value of ``by`` get a folder of their own, so a filter on it reads only these.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    # A table of folders that has no rows has no files to tell its columns.
    reader = df.sparkSession.read.schema(df.schema) if by else df.sparkSession.read
    table = reader.parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, [table.written_at])
