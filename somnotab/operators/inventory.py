"""File inventory: types, validity and counters from a table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somnotab.specs.exams import READABLE


def extension(path: Column) -> Column:
    """Lower-cased suffix without the dot; empty for names without one or starting with it."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def inventory(files: DataFrame) -> DataFrame:
    """Add ``ext`` and ``valid`` (a type that is read)."""
    return files.withColumn("ext", extension(F.col("path"))).withColumn(
        "valid", F.col("ext").isin(*READABLE)
    )


def parent_folders(files: DataFrame, root: str = "") -> DataFrame:
    """Distinct folders below ``root`` that hold a file somewhere beneath them.

    Parents are made distinct before their ancestors are listed, so the second, wider step
    works on folders, not on files.
    """
    inside = F.substring(F.col("path"), len(root) + 1, F.length("path"))
    parents = (
        files.where(F.startswith(F.col("path"), F.lit(root)))
        .select(F.regexp_replace(inside, "/?[^/]*$", "").alias("folder"))
        .where("folder != ''")
        .distinct()
    )
    steps = F.split("folder", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")
    )
    return (
        parents.select(F.explode(ancestors).alias("folder"))
        .where("folder != '' and not endswith(folder, '/') and not endswith(folder, ':')")
        .distinct()
    )


def counters(inventoried: DataFrame) -> DataFrame:
    """One row ``(num_files, valid_files, discarded_files)``."""
    return inventoried.agg(
        F.count("*").alias("num_files"),
        F.count_if("valid").alias("valid_files"),
        F.count_if(~F.col("valid")).alias("discarded_files"),
    )


def folder_count(files: DataFrame, root: str = "") -> DataFrame:
    """One row ``(num_dirs)``."""
    return parent_folders(files, root).agg(F.count("*").alias("num_dirs"))
