"""A profile that is stored by month and refreshed month by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.operators import profile_states

MONTH = "_month"
#: The part of rows without a date; a partition has a name in any case.
UNDATED = "none"


def _write(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(profile_states.PART).parquet(path)


def refresh(
    rows: DataFrame, folder: str, date_column: str, order_by: list[str], categories: list[str] | None = None
) -> None:
    """Measure the months that ``rows`` holds, all their rows, and replace their states.

    ``categories`` are the columns whose values are counted; by default all, which makes distinct counts exact.
    """
    month = F.coalesce(F.date_format(F.col(f"`{date_column}`").try_cast("date"), "yyyy-MM"), F.lit(UNDATED))
    parted = rows.withColumn(MONTH, month)
    names = rows.columns if categories is None else categories
    _write(profile_states.states(parted, MONTH, order_by), f"{folder.rstrip('/')}/states")
    _write(profile_states.frequency_states(parted, MONTH, names), f"{folder.rstrip('/')}/frequencies")


def current(spark: SparkSession, folder: str, categories: list[str], exact: bool = True) -> DataFrame:
    """The profile of all months, from their states alone."""
    states = spark.read.parquet(f"{folder.rstrip('/')}/states")
    frequencies = spark.read.parquet(f"{folder.rstrip('/')}/frequencies")
    return profile_states.profile_of(states, frequencies, categories, exact)
