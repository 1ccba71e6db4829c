"""File trees and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPORT_COLUMNS = ("doc_id", "path", "ext", "text")


def _hadoop_path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    file_system, hadoop_path = _hadoop_path(spark, path)
    return file_system.exists(hadoop_path)


def qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, the same for every way to write it."""
    file_system, hadoop_path = _hadoop_path(spark, path)
    return file_system.makeQualified(hadoop_path).toString()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if there is no such folder."""
    file_system, folder = _hadoop_path(spark, path)
    if not file_system.exists(folder):
        return []
    return [status.getPath().getName() for status in file_system.listStatus(folder)]


def read_small(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    return "\n".join(row["value"] for row in spark.read.text(path).collect())


def delete_folder(spark: SparkSession, path: str) -> None:
    file_system, folder = _hadoop_path(spark, path)
    file_system.delete(folder, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a file or folder a name that is not taken; the folder of the new name is made."""
    file_system, target = _hadoop_path(spark, new)
    if file_system.exists(target):
        raise OSError(f"{new} exists already")
    file_system.mkdirs(target.getParent())
    if not file_system.rename(_hadoop_path(spark, old)[1], target):
        raise OSError(f"could not move {old} to {new}")


def _previous(path: str) -> str:
    return f"{path.rstrip('/')}-previous"


def restore(spark: SparkSession, path: str) -> None:
    """Put back the folder that an interrupted swap has moved aside; nothing to do otherwise."""
    if not path_exists(spark, path) and path_exists(spark, _previous(path)):
        rename(spark, _previous(path), path)


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a folder that is written in full in the place of another.

    The old one is moved aside, not deleted, until the new one has its name. A failure between the two
    is undone at once, or, if the driver is lost, by ``restore`` or the next swap.
    """
    restore(spark, path)
    delete_folder(spark, _previous(path))
    if path_exists(spark, path):
        rename(spark, path, _previous(path))
    try:
        rename(spark, fresh, path)
    except Exception:
        restore(spark, path)
        raise
    delete_folder(spark, _previous(path))


def validate_folder(spark: SparkSession, path: str) -> str:
    """The path as given; an error when it does not exist or is not a folder."""
    file_system, hadoop_path = _hadoop_path(spark, path)
    if not file_system.exists(hadoop_path):
        raise ValueError(f"path does not exist: {path}")
    if not file_system.getFileStatus(hadoop_path).isDirectory():
        raise ValueError(f"path is not a folder: {path}")
    return path


def _binary(spark: SparkSession, root: str) -> DataFrame:
    validate_folder(spark, root)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def list_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files that a path, a folder or a file, stands for."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select("path", "length")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of the files below the folder; contents are not read.

    Spark's file source leaves out empty files and names starting with a dot or underscore.
    """
    return _binary(spark, root).select("path", "length")


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of the files below the folder."""
    return _binary(spark, root).select("path", "content")


def read_reports(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The table of decoded documents, ``reports(doc_id, path, ext, text)``."""
    return spark.read.format(file_format).load(path).select(*REPORT_COLUMNS)
