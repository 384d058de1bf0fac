"""Answers that arrive more than once.

Requests are sent again after time-outs, so a request may have several answers, late ones and
broken ones among them. Of all answers one is taken whole, never a cell here and a cell there: the
newest that is valid, or, without a valid one, the newest. Newest means the highest ``attempt``,
then the latest ``arrived``; either column may be absent. What still ties is told apart by
its content, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = ("attempt", "arrived")


def _content(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns that tell versionless answers apart; maps have no order, their JSON has."""
    simple = [c for c in columns if isinstance(df.schema[c].dataType, T.AtomicType)]
    nested = [F.to_json(c) for c in columns if not isinstance(df.schema[c].dataType, T.AtomicType)]
    return [F.col(c) for c in simple] or nested


def newest(answers: DataFrame, by: Sequence[str], first: Sequence[Column] = ()) -> DataFrame:
    """One row of ``answers`` for each ``by``: of the rows that are greatest in ``first`` the newest.

    NULL keys are keys like others; a NULL version is older than any. Tasks keep one row of each
    key before the shuffle, so a key that is answered without end is one row of each task.
    """
    rest = [c for c in answers.columns if c not in by]
    version = [F.col(c) for c in VERSION if c in answers.columns]
    other = [c for c in rest if c not in VERSION]
    order = F.struct(*first, *version, *_content(answers, other)) if first or version or other else F.lit(0)
    best = F.max_by(F.struct(*rest), order) if rest else F.lit(None)
    return answers.groupBy(*by).agg(best.alias("_best")).select(*by, *(F.col(f"_best.{c}").alias(c) for c in rest))


def append_answers(answers: DataFrame, path: str) -> None:
    """Add answers to the log at ``path``; nothing in it is ever changed.

    Answers without ``arrived`` (milliseconds) get the time of the call.
    """
    if "arrived" not in answers.columns:
        answers = answers.withColumn("arrived", F.unix_millis(F.current_timestamp()))
    answers.write.mode("append").parquet(path)
