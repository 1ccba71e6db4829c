"""Whole folder trees, with what Spark's file source leaves out: empty files, hidden names, empty folders.

Folders are listed by tasks, one level of the tree after the other, so the driver sees no name. Links to
folders are folders that are not entered.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.session import stage
from somnotab.sources.files import qualified, validate_folder
from somnotab.sources.opened import can_open, system_of

SCHEMA = "path string, length long, folder boolean, entered boolean"
#: Folders that a task lists.
FOLDERS_PER_TASK = 200


def _local(folder: str):
    """Entries of a local folder; one that may not be listed has none."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir():
                    yield entry.name, 0, True, not entry.is_symlink()
                elif entry.is_file():
                    yield entry.name, entry.stat().st_size, False, False
    except PermissionError:
        return


def _entries(path: str):
    system, name = system_of(path)
    if isinstance(system, fs.LocalFileSystem):
        yield from _local(name)
        return
    for info in system.get_file_info(fs.FileSelector(name)):
        folder = info.type == fs.FileType.Directory
        yield info.base_name, 0 if folder else info.size, folder, folder


def _listed(batches):
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            rows += [(f"{path.rstrip('/')}/{name}", *rest) for name, *rest in _entries(path)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "length", "folder", "entered"])


def tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, folder)`` of everything below a folder.

    Where only Spark can open the store this is an error: its file source does not see the whole tree.
    """
    validate_folder(spark, root)
    root = qualified(spark, root)
    if not can_open(root):
        raise ValueError(f"folders of this store are not listed by tasks: {root}")
    level = spark.createDataFrame([(root,)], "path string")
    n, found = 1, None
    while n:
        entries = level.repartition(-(-n // FOLDERS_PER_TASK)).mapInArrow(_listed, SCHEMA)
        entries = stage(entries, "tree")
        found = entries if found is None else found.unionAll(entries)
        level = entries.where("entered").select("path")
        n = level.count()
    return found.select("path", "length", "folder")


def tree_files(entries: DataFrame) -> DataFrame:
    """``(path, length)`` of the files of a tree, for the inventory."""
    return entries.where("not folder").select("path", "length")


def tree_folders(entries: DataFrame) -> DataFrame:
    """One row ``(num_dirs)``: all folders, also empty ones."""
    return entries.agg(F.count_if("folder").alias("num_dirs"))
