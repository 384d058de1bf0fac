"""Connected components of a graph whose edges may chain and whose hubs may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import discard, written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the smallest node it can reach.

    Alternates two steps until nothing changes: link larger neighbours to a node's smallest
    neighbour, then smaller ones. A step is a minimum per node (combined before the shuffle, so
    a hub is one row per task) and a join back. Each round is written to the shared folder.
    Nodes are of one orderable type and not NULL; loops and repeated edges do no harm.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")

    first = now = written(linked(edges.select("a", "b")), "edges")
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large star: larger neighbours of a node go to the least of the node and its neighbours.
        large = linked(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # Small star: a node and its smaller neighbours go to the least of these.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        )
        last, now = now, written(linked(small), "edges")
        # The first edges name the nodes; of the rounds only the last is read again.
        if last is not first:
            discard(last)
        state = now.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
