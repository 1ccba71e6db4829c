import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from somnotab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "somnotab-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over one text column; results in input order."""
    from pyspark.sql import functions as F

    def evaluate(function, inputs, kind="string"):
        frame = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
        rows = frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in rows]

    return evaluate
