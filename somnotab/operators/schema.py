"""Union by column name and comparison of source schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column absent from a frame is NULL there. No shuffle."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_shapes(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``(source, n_rows, n_columns)``.

    ``rows`` has one line per data row with its ``source``, or is counted already as
    ``(source, n_rows)``; ``columns`` is the ``(source, column)`` table. A source without rows is
    listed with zero.
    """
    counts = rows if "n_rows" in rows.columns else rows.groupBy("source").agg(F.count("*").alias("n_rows"))
    widths = columns.groupBy("source").agg(F.countDistinct("column").alias("n_columns"))
    return widths.join(counts, "source", "left").select(
        "source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_columns"
    )


def missing_columns(columns: DataFrame) -> DataFrame:
    """``(source, missing)``: columns some source has and this one lacks.

    Instead of pairing every source with every column, each source's own set is subtracted
    from the union set, a scalar subquery whose array is as long as there are column names.
    """
    own = columns.groupBy("source").agg(F.collect_set("column").alias("own"))
    every = columns.agg(F.collect_set("column")).scalar()
    return own.select("source", F.sort_array(F.array_except(every, "own")).alias("missing"))


def differences_from_base(columns: DataFrame, base: str) -> DataFrame:
    """``(source, missing, extra)`` of each source against the base source's columns.

    A base that is no source is refused at once.
    """
    of_base = columns.where(F.col("source") == base)
    if of_base.isEmpty():
        raise ValueError(f"no source named {base!r}")
    expected = of_base.agg(F.collect_set("column")).scalar()
    own = columns.groupBy("source").agg(F.collect_set("column").alias("own"))
    return own.select(
        "source",
        F.sort_array(F.array_except(expected, "own")).alias("missing"),
        F.sort_array(F.array_except("own", expected)).alias("extra"),
    )


def column_table(frames: dict[str, DataFrame]) -> DataFrame:
    """``(source, column)`` of named frames; schema only, no data is read."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(name, column) for name, frame in frames.items() for column in frame.columns]
    return spark.createDataFrame(rows, "source string, column string")
