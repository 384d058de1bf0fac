"""Every registered query against its SQL, on the smallest data; plan shapes."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

from .conftest import SF

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 4


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_the_hot_path(spark):
    for name in ("untranslated_by_lang", "polish", "mask_translation", "quality_totals", "update_sheet"):
        assert "Python" not in plan(spark, name), name


def test_no_cross_joins(spark):
    for name in ("template_matches", "missing_combinations", "cross_check", "row_ranges", "quality_issues"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_samples_are_cut_before_the_shuffle(spark):
    for name in ("issue_samples", "latest_rows"):
        text = plan(spark, name)
        assert "WindowGroupLimit" in text or "TakeOrdered" in text, name


def test_no_single_task_over_rows(spark):
    """What one task sees is a limit's rows, or one row for each partition of a sort."""
    from sheetqa.operators.quality import first_n, row_ranges

    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey as row_idx")
    limited = first_n(rows, [], ["row_idx"], 2000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in limited
    for df in (row_ranges(rows, 2000), QUERIES["retry_request_batches"](spark, SF)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("SinglePartition") <= 3, text


def test_scans_read_needed_columns_only(spark):
    assert "ReadSchema: struct<text:string,lang:string>" in plan(spark, "untranslated_by_lang")
