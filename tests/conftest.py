import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from verdigraph import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a column function on a list of texts, results in input order."""

    def run(texts, fn, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(texts)), f"i bigint, x {kind}")
        return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
