import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402
from sheetqa.store import remove_written  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    own = session("4")
    yield own
    remove_written(own)


@pytest.fixture(scope="session")
def values(spark):
    """Apply a Column function to a list of strings and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
        return [r[0] for r in df.select(fn(F.col("v")), "i").orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def pairs(spark):
    """The same for a function of two string columns."""
    from pyspark.sql import functions as F

    def run(fn, rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
        return [r[0] for r in df.select(fn(F.col("a"), F.col("b")), "i").orderBy("i").collect()]

    return run
