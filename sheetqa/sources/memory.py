"""The translation memory as a stored table.

Results lie in hash buckets of their request's key, sorted. A lookup deals out the requests by
the same buckets and reads the memory where it lies; it is never shuffled. What is new is
appended, nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import keyed_requests

BUCKETS = 64


def open_memory(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> str:
    """Declare the memory at ``path`` as table ``name``; what is stored there already is found again."""
    spark.sql(
        f"create table if not exists {name} (request_key string, result string) using parquet "
        f"clustered by (request_key) sorted by (request_key) into {int(buckets)} buckets location '{path}'"
    )
    return name


def look_up(requests: DataFrame, name: str) -> DataFrame:
    """Requests with the stored ``result`` (NULL: not in memory) and ``hit``."""
    keyed = keyed_requests(requests)
    known = requests.sparkSession.table(name).withColumn("hit", F.lit(True))
    # Sorted and merged by bucket: neither side is sent whole to all tasks.
    joined = keyed.join(known.hint("merge"), "request_key", "left")
    return joined.withColumn("hit", F.coalesce("hit", F.lit(False)))


def remember(results: DataFrame, name: str) -> None:
    """Add ``results(request_key, result)`` whose keys are new; a known key keeps its result.

    Of results with one new key the least is kept. A row without key is left out.
    """
    spark = results.sparkSession
    buckets = int({r[0]: r[1] for r in spark.sql(f"describe extended {name}").collect()}["Num Buckets"])
    fresh = results.where("request_key is not null").groupBy("request_key").agg(F.min("result").alias("result"))
    fresh = fresh.join(spark.table(name).select("request_key").hint("merge"), "request_key", "left_anti")
    # One task per bucket writes one file per bucket.
    fresh.repartition(buckets, "request_key").write.mode("append").insertInto(name)
