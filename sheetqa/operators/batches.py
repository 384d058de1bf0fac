"""Request batches for external models, their answers, and what to do when a batch fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.glossary import GLOSSARY, GlossaryEntry, glossary_prompt
from ..functions.masking import mask_translation
from ..functions.text import json_quote
from ..ranking import ranked
from ..schema import doc_keys, row_keys
from .answers import newest
from .classify import pending_cells

# Batch sizes, engine order, and the messages of unparsable output.
SHEET_BATCH = 5
UNIT_BATCH = 20
RETRY_BATCH = 5
ENGINE_PRIORITY = ("openrouter", "deepseek", "gemini")
RECOVERABLE = (
    "failed to parse model json",
    "expected ':' after property name",
    "invalid json",
    "did not return a json array",
    "returned invalid json",
)


def sanitize_cells(cells: DataFrame, lang: str, mode: str = "full") -> DataFrame:
    """Add ``sanitized``: masked where the cell is to be translated, else as it is."""
    send = pending_cells(cells, lang, mode)
    masked = mask_translation(F.col("original"))["sanitized"]
    return cells.withColumn("sanitized", F.when(send, masked).otherwise(F.col("original")))


def _field(df: DataFrame) -> Column:
    """One JSON object member; numbers and booleans stay bare."""
    value = json_quote(F.col("sanitized"))
    if "value_type" in df.columns:
        value = F.when(F.col("value_type") == "string", value).otherwise(F.col("sanitized"))
    return F.concat(json_quote(F.col("col_key")), F.lit(":"), value)


def row_records(cells: DataFrame, placement: Sequence[str] = ()) -> DataFrame:
    """One JSON record per row from ``sanitized`` cells, members in column order.

    A row is as wide as its sheet, so the collected list is bounded by that width.
    ``placement`` columns are carried along as extra grouping keys.
    """
    order = "col_idx" if "col_idx" in cells.columns else "col_key"
    member = F.struct(F.col(order).alias("o"), _field(cells).alias("m"))
    members = F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"])
    keys = list(dict.fromkeys([*placement, *row_keys(cells)]))
    return cells.groupBy(*keys).agg(
        F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("record")
    )


def _payloads(records: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "record")))
    return records.groupBy(*doc_keys(records), "batch_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("row_idx").alias("first_row"),
        F.transform(ordered, lambda x: x["row_idx"]).alias("rows"),
        F.concat(
            F.lit("["),
            F.array_join(F.transform(ordered, lambda x: x["record"]), ","),
            F.lit("]"),
        ).alias("payload"),
    )


def place_rows(cells: DataFrame, size: int, align: bool) -> DataFrame:
    """JSON records with ``batch_id`` and ``seq``.

    ``align``: batches are cut over *all* row positions, pending or not. Otherwise they are
    cut over the given rows only, counted in order.
    """
    if align:
        placed = cells.withColumn("batch_id", F.expr(f"row_idx div {int(size)}"))
        # Both groupings below have the batch among their keys: one shuffle serves the two.
        placed = placed.repartition(*doc_keys(cells), "batch_id")
        batch = [*doc_keys(cells), "batch_id"]
        position = F.row_number().over(Window.partitionBy(*batch).orderBy("row_idx"))
        return row_records(placed, batch).withColumn("seq", position - 1)
    numbered = ranked(row_records(cells), doc_keys(cells))
    return (
        numbered.withColumn("batch_id", F.expr(f"(rank - 1) div {int(size)}"))
        .withColumn("seq", ((F.col("rank") - 1) % size).cast("int"))
        .drop("rank")
    )


def make_request_batches(cells: DataFrame, size: int, align: bool) -> DataFrame:
    """``(batch_id, n_records, first_row, rows, payload)``; the payload is a JSON array of records.

    ``rows`` lists the row indices in payload order. ``cells`` hold the cells to send with their ``sanitized`` text.
    """
    return _payloads(place_rows(cells, size, align))


def request_prompts(
    batches: DataFrame, glossary: Sequence[GlossaryEntry] = GLOSSARY
) -> DataFrame:
    """Batches with the glossary text and the payload as one ``prompt``."""
    return batches.withColumn(
        "prompt", F.concat(glossary_prompt(glossary), F.lit("\n\nINPUT:\n"), F.col("payload"))
    )


def validate_responses(
    requests: DataFrame,
    responses: DataFrame,
    by: Sequence[str] = ("batch_id",),
    keep: Sequence[str] = ("rows",),
) -> DataFrame:
    """Check parsed answers against their requests.

    ``requests(by…, n_records)``, ``responses(by…, records, error)`` with
    ``records`` an array of maps (NULL for an item that is no object). A batch fails when it
    has no answer, when the counts differ or when an item is no object. The requests' columns
    named in ``keep`` stay, so that answers need no second join with them. One row per request comes
    back: of several answers the newest that passes, else the newest (``answers.newest``).
    """
    got = F.coalesce(F.size("records"), F.lit(0))
    counts = F.format_string(
        "Translation returned %d records (expected %d).",
        F.greatest(got, F.lit(0)).cast("int"),
        F.col("n_records").cast("int"),
    )
    kept = ["n_records", *(c for c in keep if c in requests.columns)]
    # Parsed records are many times the size of their files: not to be sent to the driver.
    joined = requests.select(*by, *kept).join(responses.hint("merge"), list(by), "left")
    error = (
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error"))
        .when(F.col("records").isNull() | (got != F.col("n_records")), counts)
        .when(
            F.exists("records", lambda r: r.isNull()),
            F.lit("Translation returned invalid record data."),
        )
        .otherwise("")
    )
    checked = joined.withColumn("error", error).withColumn("ok", F.col("error") == "")
    return newest(checked, by, first=[F.col("ok")]).select(*checked.columns)


def is_recoverable(error: Column) -> Column:
    hit = F.lit(False)
    for fragment in RECOVERABLE:
        hit = hit | F.lower(error).contains(fragment)
    return hit


def bisect_failed_batches(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Split each recoverably failed batch of more than one row at ``ceil(n / 2)``.

    ``requests(batch_id STRING, seq, …)`` has one row per record; ``status(batch_id, error)``.
    New batches are ``{id}.0`` and ``{id}.1`` with ``seq`` from 0. One round per call; batches
    of one row and other errors are not returned: they stay failed. Batches are of a fixed
    small size, so counting within a batch stays small.
    """
    failed = status.filter(is_recoverable(F.col("error"))).select("batch_id").distinct()
    rows = requests.join(failed, "batch_id", "left_semi")
    sizes = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    half = F.ceil(F.col("_n") / 2)
    left = F.col("seq") < half
    return (
        rows.join(sizes.filter(F.col("_n") > 1), "batch_id")
        .withColumn(
            "batch_id",
            F.concat(
                F.col("batch_id").cast("string"), F.when(left, F.lit(".0")).otherwise(".1")
            ),
        )
        .withColumn("seq", F.when(left, F.col("seq")).otherwise(F.col("seq") - half).cast("int"))
        .drop("_n")
    )


def request_key(lang: Column, records: Column, model: Column, mode: Column) -> Column:
    """Fingerprint of a request; a request without a chosen model is keyed as ``auto``."""
    parts = F.struct(
        lang.alias("lang"),
        records.alias("records"),
        F.coalesce(F.nullif(model, F.lit("")), F.lit("auto")).alias("model"),
        mode.alias("mode"),
    )
    return F.sha2(F.to_json(parts), 256)


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Requests with their ``request_key``, as given or made from their content."""
    if "request_key" in requests.columns:
        return requests
    key = request_key(F.col("lang"), F.col("payload"), F.col("model"), F.col("mode"))
    return requests.withColumn("request_key", key)


def memory_lookup(requests: DataFrame, memory: DataFrame) -> DataFrame:
    """Requests with the stored ``result`` (NULL: not in memory) and ``hit``.

    A key that ``memory(request_key, result)`` holds more than once counts once, by its least
    result, as ``memory_append`` would keep it.
    """
    known = memory.groupBy("request_key").agg(F.min("result").alias("result")).withColumn("hit", F.lit(True))
    return (
        keyed_requests(requests)
        .join(known, "request_key", "left")
        .withColumn("hit", F.coalesce(F.col("hit"), F.lit(False)))
    )


def memory_misses(requests: DataFrame, memory: DataFrame) -> DataFrame:
    return keyed_requests(requests).join(memory.select("request_key"), "request_key", "left_anti")


def memory_append(memory: DataFrame, results: DataFrame) -> DataFrame:
    """Memory with new ``results(request_key, result)``; a known key keeps its result."""
    fresh = results.groupBy("request_key").agg(F.min("result").alias("result"))
    fresh = fresh.join(memory.select("request_key"), "request_key", "left_anti")
    return memory.select("request_key", "result").unionByName(fresh)


def pick_engine(
    responses: DataFrame,
    by: Sequence[str] = ("batch_id",),
    priority: Sequence[str] = ENGINE_PRIORITY,
    chosen: str | None = None,
) -> DataFrame:
    """Per batch the first engine in priority order that succeeded.

    ``responses(by…, engine, ok, text)``. A ``chosen`` engine restricts to itself. Batches
    where none succeeded have NULL ``engine`` and ``write_failed``.
    """
    engines = [chosen] if chosen in priority else list(priority)
    order = F.coalesce(
        *[F.when(F.col("engine") == name, F.lit(i)) for i, name in enumerate(engines)]
    )
    usable = F.when(F.col("ok"), order)
    answer = F.struct("engine", "text")
    best = F.min_by(F.when(usable.isNotNull(), answer), usable)
    return (
        responses.groupBy(*by)
        .agg(best.alias("_best"))
        .select(
            *by,
            F.col("_best.engine").alias("engine"),
            F.col("_best.text").alias("text"),
            F.col("_best").isNull().alias("write_failed"),
        )
    )


def pending_requests(
    cells: DataFrame, pending_rows: DataFrame, lang: str, mode: str = "full",
    size: int = SHEET_BATCH,
) -> DataFrame:
    """Sheet batches: aligned to all rows, then only the pending rows of each."""
    keys = row_keys(cells)
    todo = cells.join(pending_rows.select(*keys).distinct(), keys, "left_semi")
    return make_request_batches(sanitize_cells(todo, lang, mode), size, align=True)


def answer_cells(checked: DataFrame) -> DataFrame:
    """Answers of the batches that passed, as ``(keys, col_key, answer)``.

    ``checked`` by ``validate_responses`` over batches of ``make_request_batches``. The n-th
    record of an answer belongs to the n-th row of its batch.
    """
    pairs = checked.filter("ok").select(
        *doc_keys(checked), F.explode(F.arrays_zip("rows", "records")).alias("p")
    )
    return pairs.select(
        *doc_keys(checked),
        F.col("p.rows").alias("row_idx"),
        F.explode("p.records").alias("col_key", "answer"),
    )


def row_outcome(checked: DataFrame) -> DataFrame:
    """``(row keys, ok)`` for every row that was sent; rows that are not ok are write-failed."""
    return checked.select(*doc_keys(checked), F.explode("rows").alias("row_idx"), "ok")
