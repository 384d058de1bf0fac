"""Batches that were split after a failure, and how their halves become one answer again.

A split of batch ``7`` gives ``7.0`` and ``7.1``, a further split ``7.0.0`` and ``7.0.1``: the id is a
path. Requests and answers of all levels live in the same tables. A batch counts as answered
when it is valid itself, or when all its leaves are; then its records are those of the leaves,
in the order of their paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.responses import parse_responses
from ..store import written
from .batches import is_recoverable, validate_responses


def _with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("batch_id", F.col("batch_id").cast("string"))


def _level() -> Column:
    """The number of steps in a batch's path."""
    return F.size(F.split("batch_id", r"\.", -1))


def halves(batches: DataFrame) -> DataFrame:
    """Each batch of more than one record as two, cut at ``ceil(n / 2)``.

    ``batches(…, batch_id, n_records, rows)``; a ``payload`` is cut as well. Others are left out.
    """
    half = F.ceil(F.col("n_records") / 2).cast("int")
    parts = []
    for side in (0, 1):
        start = F.lit(1) if side == 0 else half + 1
        length = half if side == 0 else F.col("n_records").cast("int") - half

        def cut(items: Column, start: Column = start, length: Column = length) -> Column:
            return F.slice(items, start, length)

        fields = {
            "batch_id": F.concat(F.col("batch_id").cast("string"), F.lit(f".{side}")),
            "n_records": length.cast("long"),
            "rows": cut(F.col("rows")),
        }
        if "first_row" in batches.columns:
            fields["first_row"] = F.get(fields["rows"], 0)
        if "payload" in batches.columns:
            records = F.from_json("payload", "array<string>")
            fields["payload"] = F.concat(F.lit("["), F.array_join(cut(records), ","), F.lit("]"))
        parts.append(F.struct(*(fields.get(c, F.col(c)).alias(c) for c in batches.columns)))
    return (
        batches.where("n_records > 1").select(F.explode(F.array(*parts)).alias("_half")).select("_half.*")
    )


def split_rounds(batches: DataFrame, responses: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """All leaves: the batches that were not split further, each with its newest valid answer.

    ``batches`` as of ``make_request_batches``; ``responses(by…, text)`` hold answers of every level
    under their paths, several per path if they were asked for more than once. Round by round the
    batches that failed recoverably are split and their halves' answers looked up, until none is
    left: ``ceil(log2(records))`` rounds at most. A batch is split only while no answer to it is
    valid. Adds ``root``, ``awaits`` (nothing has been answered) and what ``validate_responses`` adds.

    A path is one step longer each round, so a round reads the answers of its own level only, and parses
    those that something still waits for.
    """
    by = list(by)
    keep = [c for c in batches.columns if c in (*by, "n_records", "rows", "payload", "first_row")]
    answers = written(_with_path(responses).withColumn("_level", _level()), "split-answers", by="_level")
    now = written(_with_path(batches.select(*keep)).withColumn("root", F.col("batch_id")), "split-batches")
    first, last = now.agg(F.min(_level()), F.max(_level())).first()
    leaves = None
    step = 0
    while True:
        kept = [c for c in now.columns if c not in (*by, "n_records")]
        here = answers.where(F.col("_level").between(F.lit(first) + step, F.lit(last) + step)).drop("_level")
        asked = here.join(now.select(*by).hint("merge"), by, "left_semi")
        checked = validate_responses(now, parse_responses(asked).withColumn("_met", F.lit(True)), by, kept)
        checked = checked.withColumn("awaits", F.col("_met").isNull()).drop("_met")
        checked = written(checked, "split-round")
        again = ~F.col("ok") & (F.col("n_records") > 1) & is_recoverable(F.col("error"))
        done = checked.where(~again)
        leaves = done if leaves is None else leaves.unionByName(done)
        now = halves(checked.where(again).select(*now.columns))
        if now.isEmpty():
            return leaves
        step += 1


def pending_splits(leaves: DataFrame) -> DataFrame:
    """Requests of the next round: leaves below a split that nothing has answered yet."""
    return leaves.where(F.col("awaits") & (F.col("batch_id") != F.col("root")))


def roll_up(leaves: DataFrame, by: Sequence[str] = ("batch_id",), roots_only: bool = True) -> DataFrame:
    """Leaves put together: one row per batch that was asked for, or per node of every tree.

    ``by…, n_records, rows, records, error, ok, n_leaves``. A node is ok when all its leaves are;
    its error is the first failed leaf's, in order, and then it has no records. A tree has at
    most as many leaves as its batch has records, so a node's list stays small.
    """
    other = [c for c in by if c != "batch_id"]
    if roots_only:
        placed = leaves.withColumn("_node", F.col("root"))
    else:
        # A leaf belongs to each prefix of its path that is not shorter than its root.
        steps = F.split("batch_id", r"\.", -1)
        first = F.size(F.split("root", r"\.", -1))
        nodes = F.transform(F.sequence(first, F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))
        placed = leaves.withColumn("_node", F.explode(nodes))
    leaf = F.struct("batch_id", "n_records", "rows", "records", "error", "ok")
    gathered = placed.groupBy(*other, "_node").agg(F.collect_list(leaf).alias("_leaves"))
    # Sides are single digits, so paths below one root sort as strings.
    ordered = F.array_sort(
        "_leaves", lambda x, y: F.when(x["batch_id"] < y["batch_id"], -1).when(x["batch_id"] > y["batch_id"], 1).otherwise(0)
    )
    result = gathered.withColumn("_leaves", ordered)
    failed = F.filter("_leaves", lambda x: ~x["ok"])
    ok = F.size(failed) == 0
    return result.select(
        *other,
        F.col("_node").alias("batch_id"),
        F.aggregate("_leaves", F.lit(0).cast("long"), lambda acc, x: acc + x["n_records"]).alias("n_records"),
        F.flatten(F.transform("_leaves", lambda x: x["rows"])).alias("rows"),
        F.when(ok, F.flatten(F.transform("_leaves", lambda x: x["records"]))).alias("records"),
        F.coalesce(F.get(failed, 0)["error"], F.lit("")).alias("error"),
        ok.alias("ok"),
        F.size("_leaves").alias("n_leaves"),
    ).select(*by, "n_records", "rows", "records", "error", "ok", "n_leaves")


def resolve_splits(batches: DataFrame, responses: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """``validate_responses`` over answers of all levels of splits; ids are strings."""
    return roll_up(split_rounds(batches, responses, by), by)
