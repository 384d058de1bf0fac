"""Row numbers and running sums inside groups of any size, by any order.

``row_number() over (partition by doc order by row_idx)`` puts one document into one task.
Here the rows are sorted by group and order in range partitions and written once; sums inside a
partition take a window over that partition's rows, sums before it come from one row for each
group in each partition. How the order's values lie does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

_EARLIER = Window.unboundedPreceding, -1
# A position is the partition's number above this bit, the place in the partition below it.
_PLACE_BITS = 33


def running(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column]
) -> DataFrame:
    """Add a column per entry of ``sums``: its value's sum over the group's earlier rows.

    ``order`` should leave no ties; what it leaves is in arbitrary, fixed order. NULL is a group
    like others. Rows are shuffled for the sort, and once more to meet their starts.
    """
    groups = list(groups)
    values = {f"_value_{out}": value.cast("bigint") for out, value in sums.items()}
    rows = written(
        df.withColumns(values)
        .orderBy(*groups, *order)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "sorted",
    ).withColumn("_part", F.shiftright("_pos", _PLACE_BITS))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]
    per_part = rows.groupBy(*groups, "_part").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(*_EARLIER)
    starts = per_part.select(
        *(F.col(g).alias(f"_of_{g}") for g in groups),
        F.col("_part").alias("_of_part"),
        *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_start{v}") for v in values),
    )
    inside = Window.partitionBy(*groups, "_part").orderBy("_pos").rowsBetween(*_EARLIER)
    counted = rows.withColumns(
        {f"_inside{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    )
    met = counted.join(starts, [F.col("_part") == F.col("_of_part"), *same])
    return met.select(
        *df.columns,
        *((F.col(f"_start_value_{out}") + F.col(f"_inside_value_{out}")).alias(out) for out in sums),
    )


def ranked(
    df: DataFrame, groups: Sequence[str], idx: str = "row_idx", out: str = "rank"
) -> DataFrame:
    """Add ``out`` = 1, 2, … by ``idx`` inside each group; ``idx`` is unique in its group."""
    return running(df, groups, [idx], {out: F.lit(1)}).withColumn(out, F.col(out) + 1)
