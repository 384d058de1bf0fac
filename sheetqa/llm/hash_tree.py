"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level a key draws once for each child, ``-ln(u) / weight`` with ``u`` from a hash of the
key and the child's path; the smallest draw wins. A child's draw depends on its own weight only,
so a changed weight moves keys only into or out of that child: all other subtrees keep theirs.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from .common import running_before, text_crc32


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def shard_tree(shards: int, built: int = 40, per_rack: int = 5, racks: int = 2) -> list[Shard]:
    """A tree with shards 0 to ``shards - 1`` of equal weight.

    The first ``built`` shards fill regions of ``racks`` racks of ``per_rack`` shards. Each later
    shard opens a region of its own: no existing subtree's weight changes, so rows move only
    into the new shard.
    """
    return [
        Shard(f"r{i // (racks * per_rack)}", f"k{i // per_rack}", i)
        if i < built
        else Shard(f"x{i}", f"k{i}", i)
        for i in range(shards)
    ]


def children(tree: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    """Path of a node (the root's is empty) to the paths and weights of its children.

    A node weighs what its shards weigh together. Shards without weight are left out.
    """
    weights: dict[str, float] = defaultdict(float)
    below: dict[str, set[str]] = defaultdict(set)
    seen: set[int] = set()
    for s in tree:
        if s.shard in seen:
            raise ValueError(f"shard {s.shard} is in the tree twice")
        seen.add(s.shard)
        if s.weight <= 0:
            continue
        path = [s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for parent, child in zip(["", *path], path):
            below[parent].add(child)
            weights[child] += s.weight
    if not weights:
        raise ValueError("no shard has a weight above 0")
    return {p: [(c, weights[c]) for c in sorted(cs)] for p, cs in below.items()}


def place(df: DataFrame, key: str, tree: list[Shard], out: str = "shard") -> DataFrame:
    """Add ``out`` (int): the shard that ``key`` descends to; equal keys meet, NULL is a key too.

    The tree is a literal in the plan: each row draws once per child on its path, and no
    shuffle, join or Python is needed.
    """
    nodes = children(tree)
    below = F.create_map(
        *(
            x
            for path, kids in nodes.items()
            for x in (
                F.lit(path),
                F.array(*(F.struct(F.lit(c).alias("path"), F.lit(w).alias("weight")) for c, w in kids)),
            )
        )
    )

    def draw(kid: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.col(key), kid["path"]), 11) + 1) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / kid["weight"]).alias("draw"), kid["path"].alias("path"))

    at = F.lit("")
    for level in ("_region", "_rack", "_leaf"):
        df = df.withColumn(level, F.array_min(F.transform(F.element_at(below, at), draw))["path"])
        at = F.col(level)
    return df.withColumn(out, F.substring_index("_leaf", "/", -1).cast("int")).drop(
        "_region", "_rack", "_leaf"
    )


def shard_documents(
    docs: DataFrame, tree: list[Shard], grown: list[Shard], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 16, a NULL text has none. ``slot`` numbers a shard's
    rows from 0 without gaps, in the order of a hash of the key. Law ``key``: the key and the
    tree alone decide, so copies under several ids may part; ``grown_shard`` is the place in
    the larger tree. Rows with a NULL key share one shard, repeated rows get a slot each (their
    order among themselves is arbitrary, the rows are equal); an empty table gives no rows.
    Only these narrow columns are shuffled.
    """
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"),
    )
    placed = place(place(narrow, "doc_id", tree), "doc_id", grown, "grown_shard")
    # The scrambled key orders a shard's rows; the checksum parts rows that share a key.
    placed = placed.withColumn("_order", F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"))
    numbered = running_before(
        written(placed, "placed"), "shard", "_order", ["doc_id", "text_crc32", "size"], F.lit(1), "slot"
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
