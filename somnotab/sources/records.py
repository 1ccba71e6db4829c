"""Records of delimited files whose quoted values hold line ends, read by many tasks for each file.

Whether a line end closes a record depends on all quotes before it in the file. Files are split by
Spark as ever; a first pass counts the quotes of every split, a running sum over the splits of a
file says whether a split begins inside a quoted value, and the second pass cuts the lines of a split
into records with that start. What a split begins or ends in the middle of is handed over as a fragment, and
the fragments of a record are joined at the end: at most two rows for each split.
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of split starts that are sent to all tasks; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_WHOLE, _BEGIN, _INNER, _END = range(4)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, split, at, value)``; ``at`` rises with the place in the split."""
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", True)
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),
            "value",
        )
    )


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def open_splits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, split, inside)``: whether a split begins within quotes. One row for each split."""
    counted = _lines(spark, paths).groupBy("file", "split").agg(F.sum(_quotes(F.col("value"))).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    return counted.select("file", "split", inside.alias("inside"))


def _cut(batches):
    """Lines of splits, in order, to whole records and fragments."""
    place, first, begun, inside, held = None, None, False, False, []

    def fragment(kind):
        return (*place, first, kind, "\n".join(held))

    for batch in batches:
        rows = []
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for file, split, at, value, start in zip(*columns, strict=True):
            if (file, split) != place:
                if held:
                    rows.append(fragment(_BEGIN if begun else _INNER))
                place, first, begun, inside, held = (file, split), at, not start, start, []
            if not held and not inside:
                first, begun = at, True
            held.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                rows.append(fragment(_WHOLE if begun else _END))
                held, begun = [], True
        if rows:
            yield _rows(rows)
    if held:
        yield _rows([fragment(_BEGIN if begun else _INNER)])


def _rows(rows):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["file", "split", "at", "kind", "record"])


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, split, at, record)``: the text of every record, in file order by ``split`` and ``at``.

    Blank lines between records are left out, and so is a carriage return at the end of a record.
    """
    starts = open_splits(spark, paths)
    keyed = starts.select(F.xxhash64("file", "split").alias("place"), "inside")
    lines = _lines(spark, paths).withColumn("place", F.xxhash64("file", "split"))
    if starts.count() * 32 <= BROADCAST_BYTES:
        joined = lines.join(F.broadcast(keyed), "place")
    else:
        joined = lines.join(keyed, "place").sortWithinPartitions("file", "split", "at")
    pieces = joined.select("file", "split", "at", "value", "inside").mapInArrow(
        _cut, "file string, split long, at long, kind int, record string"
    )
    whole = pieces.where(F.col("kind") == _WHOLE).select("file", "split", "at", "record")
    fragments = pieces.where(F.col("kind") != _WHOLE)
    so_far = Window.partitionBy("file").orderBy("split", "at")
    number = F.sum((F.col("kind") == _BEGIN).cast("int")).over(so_far)
    parts = F.sort_array(F.collect_list(F.struct("split", "at", "record")))
    joined = (
        fragments.withColumn("number", number)
        .groupBy("file", "number")
        .agg(parts.alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["split"].alias("split"),
            F.col("parts")[0]["at"].alias("at"),
            F.array_join(F.col("parts.record"), "\n").alias("record"),
        )
    )
    every = whole.unionAll(joined).withColumn("record", F.regexp_replace("record", "\r\\z", ""))
    return every.where("record <> ''")


def _names(header: str) -> list[str]:
    return next(csv.reader([header.lstrip("﻿")], strict=False))


def parsed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Records of one header as columns of text; the header itself must not be among them."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    values = rows.select(F.from_csv("record", schema.toDDL(), options).alias("v"))
    return values.select(*[F.col("v")[f"c{i}"].alias(name) for i, name in enumerate(names)])


def without_headers(rows: DataFrame) -> DataFrame:
    """All records but the first of every file."""
    begin = rows.where("split = 0").groupBy("file").agg(F.min("at").alias("at")).select("file", F.lit(0).alias("split"), "at")
    return rows.join(begin, ["file", "split", "at"], "left_anti")
