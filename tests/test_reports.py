import os

import pytest
from pyspark.sql import functions as F

from checks import queries as registered
from checks import reports as rp

FOLDER = "/root/testdata/sf0.001"


def test_spread_makes_more_tasks_of_more_rows(spark, monkeypatch):
    """A task's rows do not grow with the table, so neither does what it sorts at once."""
    monkeypatch.setattr(rp, "ROWS_PER_TASK", 100)
    cores = spark.sparkContext.defaultParallelism
    for n in (0, 50, 10_000):
        spread = rp.spread(spark.range(n))
        sizes = spread.groupBy(F.spark_partition_id()).count().collect()
        assert spread.rdd.getNumPartitions() == max(cores, n // 100)
        assert sum(r["count"] for r in sizes) == n
        assert all(r["count"] <= 110 for r in sizes)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_cells_of_more_workbooks_are_made_by_more_tasks(spark, monkeypatch):
    """What a task of cells_pivot sorts before the shuffle does not grow with the table; the records are the same."""
    whole = sorted(registered.cells_pivot(spark, FOLDER).collect())
    monkeypatch.setattr(rp, "ROWS_PER_TASK", 50, raising=False)
    cells = registered._cells(spark, FOLDER)
    per_task = cells.groupBy(F.spark_partition_id()).agg(F.count_distinct("file").alias("n")).collect()
    assert sum(r["n"] for r in per_task) == spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert all(r["n"] <= 60 for r in per_task)
    assert sorted(registered.cells_pivot(spark, FOLDER).collect()) == whole
