"""Delimited result files and JSON batches."""

from __future__ import annotations

import csv
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somnotab.operators.schema import union_by_name
from somnotab.sources import records
from somnotab.sources.files import list_paths, qualified
from somnotab.sources.opened import can_open, system_of

# Texts that stand for a missing value in a result file.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_texts_to_null(df: DataFrame) -> DataFrame:
    """NULL for every text that stands for a missing value."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            column = F.when(~column.isin(*NULL_TEXTS), column).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("quote", '"').option("escape", '"')


def read_table(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """One delimited table, every column text.

    Values written by this package hold no line ends; ``multi_line`` reads files that have them.
    """
    if multi_line:
        return read_results(spark, [paths] if isinstance(paths, str) else paths, multi_line=True)
    return null_texts_to_null(_csv(spark).csv(paths))


def _first_record(path: str) -> str:
    """The first record of a file, which may hold quoted line ends; no more of it than that is read."""
    system, name = system_of(path)
    begin = b""
    with system.open_input_stream(name, buffer_size=4096) as stream:
        while chunk := stream.read(4096):
            begin += chunk
            end = begin.find(b"\n")
            while end >= 0 and begin.count(b'"', 0, end) % 2:
                end = begin.find(b"\n", end + 1)
            if end >= 0:
                begin = begin[:end]
                break
    return begin.decode("utf-8-sig", "replace").rstrip("\r")


def _opened(batches):
    for batch in batches:
        found = [_first_record(path) for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["file", "header"])


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, header)``: the first record of every file.

    Tasks open the files and read their first bytes. Where only Spark can open them, the files are
    read as text, and the header ends with the first line. Empty files and names that start with a dot or an
    underscore are left out.
    """
    found = []
    for path in paths:
        if can_open(qualified(spark, path)):
            names = list_paths(spark, path).select(F.col("path").alias("file"))
            found.append(names.mapInArrow(_opened, "file string, header string"))
        else:
            lines = spark.read.option("recursiveFileLookup", True).text(path)
            at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")
            lines = lines.select(F.url_decode("_metadata.file_path").alias("file"), at, "value")
            first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
            found.append(first.withColumn("header", F.ltrim("header", F.lit("\ufeff"))))
    return reduce(DataFrame.unionAll, found)


def _named(batches):
    for batch in batches:
        names = [next(csv.reader([header])) if header else [] for header in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string()))], ["file", "columns"])


def _source(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def folder_columns(spark: SparkSession, paths: list[str], source=_source) -> DataFrame:
    """``(source, column)`` of all result files, from their headers alone.

    ``source`` names a file by its path; by default its last part. Files of one name are one source.
    """
    parsed = headers(spark, paths).mapInArrow(_named, "file string, columns array<string>")
    return parsed.select(source(F.col("file")).alias("source"), F.explode("columns").alias("column")).distinct()


def folder_rows(spark: SparkSession, paths: list[str], source=_source, multi_line: bool = False) -> DataFrame:
    """``(source, n_rows)``: records below the header, by one aggregate over all files.

    With ``multi_line`` line ends in quotes belong to a value.
    """
    if multi_line:
        rows = records.records(spark, paths).select("file")
    else:
        lines = spark.read.option("recursiveFileLookup", True).text(paths)
        rows = lines.where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"))
    files = rows.groupBy("file").agg((F.count("*") - 1).alias("n"))
    named = files.select(source(F.url_decode("file")).alias("source"), "n")
    return named.groupBy("source").agg(F.sum("n").alias("n_rows"))


def read_results(
    spark: SparkSession, paths: list[str], exclude: str | None = None, multi_line: bool = False
) -> DataFrame:
    """All result files as one table by column name.

    Every file is read by its own header, also within one folder; files of one header are one scan,
    so the plan grows with the number of different headers. ``exclude`` is the output of an earlier
    run in the same folder, however it is spelled. Text stays text: identifiers keep their
    leading zeros. ``multi_line`` is for files whose quoted values hold line ends; they are split between
    tasks like others.
    """
    left_out = None if exclude is None else qualified(spark, exclude)
    paths = [path for path in paths if qualified(spark, path) != left_out]
    if not paths:
        raise ValueError("no result files")
    layouts: dict[str, list[str]] = {}
    for row in headers(spark, paths).orderBy("file").toLocalIterator():
        layouts.setdefault(row["header"], []).append(row["file"])
    if not layouts:
        raise ValueError("no result files")
    frames = []
    for header, files in layouts.items():
        [names] = csv.reader([header])
        if multi_line:
            rows = records.without_headers(records.records(spark, files))
            frames.append(null_texts_to_null(records.parsed(rows, names)))
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        # The files stand for themselves: the folder of a run is no column of the result.
        reader = _csv(spark).option("recursiveFileLookup", True).schema(schema)
        frames.append(null_texts_to_null(reader.csv(files)))
    return union_by_name(frames)


def read_batch(spark: SparkSession, path: str, schema=None, array_file: bool = False) -> DataFrame:
    """A JSON batch: one object per line, or files holding one array each."""
    reader = spark.read.option("multiLine", array_file)
    return (reader.schema(schema) if schema is not None else reader).json(path)
