"""Intermediate tables in the shared folder, and joins with sides of a checked size."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.session import checkpoint_root
from somnotab.sources.files import delete_folder

BROADCAST_BYTES = 32 << 20
_ROOT = {}
#: Folders of the scratch scopes that are open, the innermost last.
_SCOPES: list[str] = []


def _root(spark: SparkSession) -> str:
    """One folder per application, so that a whole run can be removed at once."""
    application = spark.sparkContext.applicationId
    if application not in _ROOT:
        _ROOT[application] = f"{checkpoint_root(spark).rstrip('/')}/llm-{application}"
    return _ROOT[application]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_SCOPES[-1] if _SCOPES else _root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: what follows starts from files."""
    spark = frame.sparkSession
    path = new_path(spark, name) if path is None else path
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str):
    """Intermediate tables made within the scope are deleted at its end; what is kept has a path from outside."""
    folder = new_path(spark, name)
    _SCOPES.append(folder)
    try:
        yield
    finally:
        _SCOPES.remove(folder)
        delete_folder(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are stored."""
    folder = _ROOT.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        delete_folder(spark, folder)


def small_side(table: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The side of a join, marked for broadcast if it provably fits; else Spark shuffles both sides.

    ``rows`` is its counted length, ``row_bytes`` a bound on the size of a row in memory.
    """
    return F.broadcast(table) if rows * row_bytes <= limit else table


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, whatever the case of its own."""
    taken = {c.lower() for c in frame.columns}
    chosen = []
    for name in names:
        while f"_{name}" in taken:
            name = f"_{name}"
        chosen.append(f"_{name}")
    return chosen
