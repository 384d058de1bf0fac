"""The abnormal-indicator sheet update and its audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.library import profile as load_profile
from ..functions.sheet_text import (
    cleanup_english,
    fix_qualifier,
    insert_disease,
    prefix_text,
)
from ..functions.text import js_trim
from ..schema import row_keys

# Header texts of the sheet.
WHITE_HEADER = "AWBC#"
SICKLE_HEADER = "SRBC#"
TEXT_HEADERS = {"summary1": "总结1", "summary2": "总结2", "interpretation": "解读"}
DISEASE_HEADER = "可能疾病1"
RAISED = "↑"
STEPS = ("indicators", "cleanup_english", "fix_qualifier")


def locate_columns(columns: Sequence[str]) -> dict:
    """Which columns the update works on, from header texts and positions.

    The prompt and basis are the two columns right of an indicator; the nine disease columns
    follow each other from the first.
    """
    columns = list(columns)

    def at(header: str, width: int) -> list[str]:
        start = columns.index(header)
        return columns[start : start + width]

    found: dict = {}
    for name, header in (("white", WHITE_HEADER), ("sickle", SICKLE_HEADER)):
        if header in columns:
            found[name] = at(header, 3)
    for name, header in TEXT_HEADERS.items():
        if header in columns:
            found[name] = header
    if DISEASE_HEADER in columns:
        found["diseases"] = at(DISEASE_HEADER, 9)
    return found


def _blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def fill_prompt(
    df: DataFrame, columns: Sequence[str], config: dict, raised: Column | None = None
) -> DataFrame:
    """Fill blank prompt and basis cells of raised rows.

    ``columns``: indicator, prompt, basis; trailing ones may be absent.
    """
    raised = F.col(f"`{columns[0]}`") == RAISED if raised is None else raised
    updates = {}
    for name, text in zip(columns[1:], (config["prompt"], config["basis"])):
        cell = F.col(f"`{name}`")
        updates[name] = F.when(raised & _blank(cell), F.lit(text)).otherwise(cell)
    return df.withColumns(updates)


def _slots(names: Sequence[str]) -> Column:
    fields = ("name", "probability", "analysis")
    return F.array(
        *[
            F.struct(*[F.col(f"`{names[3 * i + j]}`").alias(f) for j, f in enumerate(fields)])
            for i in range(3)
        ]
    )


def _update_indicator(
    df: DataFrame, columns: dict, indicator: str, config: dict, data_row: Column
) -> DataFrame:
    marked = F.col(f"`{columns[indicator][0]}`") == RAISED
    raised = F.coalesce(marked & data_row, F.lit(False))
    words = config["disease"]["keywords"]
    df = fill_prompt(df, columns[indicator], config, raised)
    wording = {
        "summary1": (config["prompt"], "；"),
        "summary2": (config["short"], "；"),
        "interpretation": (config["interpretation"], " "),
    }
    updates = {}
    for name, (prefix, sep) in wording.items():
        if name in columns:
            cell = F.col(f"`{columns[name]}`")
            updates[columns[name]] = F.when(
                raised, prefix_text(cell, prefix, words, sep)
            ).otherwise(cell)
    df = df.withColumns(updates)
    if "diseases" in columns:
        names = columns["diseases"]
        slots = _slots(names)
        df = df.withColumn(
            "_slots", F.when(raised, insert_disease(slots, config["disease"])).otherwise(slots)
        )
        fields = ("name", "probability", "analysis")
        df = df.withColumns(
            {
                names[3 * i + j]: F.get("_slots", i)[field]
                for i in range(3)
                for j, field in enumerate(fields)
            }
        ).drop("_slots")
    return df


def update_sheet(
    df: DataFrame,
    profile: str = "v2",
    steps: Sequence[str] = ("indicators",),
    columns: dict | None = None,
    first_row: int | None = 1,
) -> DataFrame:
    """Update every row of a wide sheet table: white-cell indicator first, then sickle cells.

    Column groups that the sheet lacks are skipped. Row 0 is the second header line, so the
    indicator step starts at ``first_row`` = 1 (NULL: all rows); the two text cleanups
    touch every string cell. All of it is one projection over the scan.
    """
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    columns = locate_columns(df.columns) if columns is None else columns
    names = df.columns
    strings = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in ("doc_id", "sheet")
    ]
    if "indicators" in steps:
        white, sickle = load_profile(profile)
        data_row = F.lit(True) if first_row is None else F.col("row_idx") >= first_row
        for indicator, config in (("white", white), ("sickle", sickle)):
            if indicator in columns:
                df = _update_indicator(df, columns, indicator, config, data_row)
    for step, rewrite in (("cleanup_english", cleanup_english), ("fix_qualifier", fix_qualifier)):
        if step in steps:
            df = df.withColumns({n: rewrite(F.col(f"`{n}`")) for n in strings})
    return df.select(*[f"`{n}`" for n in names])


def change_audit(
    before: DataFrame, after: DataFrame, allowed: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Cells outside the ``allowed`` columns that an update changed: must be empty.

    ``columns`` are the wide columns to compare, joined on the row keys.
    """
    keys = row_keys(before)
    watched = [c for c in columns if c not in set(allowed)]
    right = after.select(*keys, *[F.col(f"`{c}`").alias(f"_after_{i}") for i, c in enumerate(watched)])
    left = before.select(*keys, *[F.col(f"`{c}`").alias(f"_before_{i}") for i, c in enumerate(watched)])
    cells = [
        F.struct(
            F.lit(c).alias("col_key"),
            F.col(f"_before_{i}").cast("string").alias("original"),
            F.col(f"_after_{i}").cast("string").alias("translated"),
        )
        for i, c in enumerate(watched)
    ]
    joined = left.join(right, keys, "full_outer")
    # The cast gives the array its type also when no column is watched.
    kind = "array<struct<col_key:string,original:string,translated:string>>"
    differing = F.filter(
        F.array(*cells).cast(kind),
        lambda x: ~js_trim(x["original"]).eqNullSafe(js_trim(x["translated"])),
    )
    return joined.select(*keys, F.explode(differing).alias("c")).select(*keys, "c.*")
