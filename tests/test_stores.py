"""Stored progress and memory: files written, interrupted and repeated saves, plans."""

import os
import uuid

from pyspark.sql import functions as F

from sheetqa.operators import batches as B
from sheetqa.sources import memory as M
from sheetqa.sources import progress as PR
from sheetqa.store import scratch_path
from sheetqa.streaming.progress import batch_saver, running_figures

ROW = "file_id string, target_lang string, row_idx long, record string"


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_many_files_share_buckets(spark):
    path = scratch_path(spark, "many")
    rows = spark.range(100_000).select(
        F.concat(F.lit("file "), "id").alias("file_id"), F.lit("English").alias("target_lang"), F.lit(0).cast("long").alias("row_idx"),
        F.col("id").cast("string").alias("record"),
    )
    assert PR.save_progress(rows, path)
    assert len(files(f"{path}/rows")) <= PR.BUCKETS
    one = PR.load_progress(spark, path, "file 4711")
    assert [(r.row_idx, r.record, r.done, r.missing) for r in one.collect()] == [(0, "4711", True, False)]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan
    PR.compact_progress(spark, path)
    assert PR.load_progress(spark, path).count() == 100_000


def test_an_interrupted_save_leaves_the_old_snapshot(spark, monkeypatch):
    path = scratch_path(spark, "interrupted")
    assert PR.load_progress(spark, path).count() == 0
    PR.save_progress(spark.createDataFrame([("f", "English", 1, "old")], ROW), path)

    def lost(*args, **kwargs):
        raise RuntimeError("driver lost")

    for step in ("_commit", "_write_pairs"):
        with monkeypatch.context() as m:
            m.setattr(PR, step, lost)
            for call in (
                lambda: PR.save_progress(spark.createDataFrame([("f", "English", 2, "new")], ROW), path),
                lambda: PR.clear_progress(spark, path, "f"),
            ):
                try:
                    call()
                except RuntimeError:
                    pass
        assert [r.record for r in PR.load_progress(spark, path).collect()] == ["old"]
    PR.save_progress(spark.createDataFrame([("f", "English", 2, "new")], ROW), path)
    assert [r.record for r in PR.load_progress(spark, path).collect()] == ["new"]
    PR.clear_progress(spark, path, "f")
    assert PR.load_progress(spark, path).count() == 0
    PR.save_progress(spark.createDataFrame([("f", "English", 3, "back")], ROW), path)
    assert [r.record for r in PR.load_progress(spark, path, "f", "English").collect()] == ["back"]


def test_a_replayed_batch_leaves_equal_totals(spark):
    path = scratch_path(spark, "replay")
    save = batch_saver(path, "s", lambda df: df)
    rows = spark.createDataFrame(
        [("f", "English", 1, "a", True, False, False), ("f", "English", 2, "b", False, None, True), ("g", "English", 1, "c", True, True, False)],
        ROW + ", done boolean, missing boolean, write_failed boolean",
    )
    for number in (0, 1, 0, 1, 1):
        save(rows, number)
    got = {tuple(r) for r in running_figures(spark, path).collect()}
    assert got == {("f", "English", 4, 2, 0, 2), ("g", "English", 2, 2, 2, 0)}


def test_memory_is_not_shuffled_and_not_rewritten(spark):
    path = scratch_path(spark, "memory")
    name = M.open_memory(spark, f"memory_{uuid.uuid4().hex}", path, 8)
    M.remember(spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k2", "x"), (None, "n")], "request_key string, result string"), name)
    before = {f: os.path.getmtime(os.path.join(path, f)) for f in files(path)}
    M.remember(spark.createDataFrame([("k1", "z"), ("k3", "y")], "request_key string, result string"), name)
    after = {f: os.path.getmtime(os.path.join(path, f)) for f in files(path)}
    assert before.items() <= after.items() and len(after) - len(before) <= 8
    again = M.open_memory(spark, f"memory_{uuid.uuid4().hex}", path, 8)
    assert {tuple(r) for r in spark.table(again).collect()} == {("k1", "a"), ("k2", "x"), ("k3", "y")}
    found = M.look_up(spark.createDataFrame([("k1",), ("k9",), (None,), ("k1",)], "request_key string"), again)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert sorted((r.request_key or "", r.result or "", r.hit) for r in found.collect()) == [
        ("", "", False), ("k1", "a", True), ("k1", "a", True), ("k9", "", False),
    ]


def test_memory_with_repeated_keys_multiplies_no_request(spark):
    memory = spark.createDataFrame([("k", "b"), ("k", "a")], "request_key string, result string")
    requests = spark.createDataFrame([("k",), ("m",)], "request_key string")
    assert sorted((r.request_key, r.result) for r in B.memory_lookup(requests, memory).collect()) == [("k", "a"), ("m", None)]
