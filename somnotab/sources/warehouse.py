"""The date-partitioned warehouse table, appended batch by batch.

    <table>/data/batch=b-<id>/<date field>=<day>/   the rows of a batch
    <table>/keys/batch=b-<id>/                      day, hash and file of its identifiers
    <table>/commits/b-<id>                          the marker: the answer that the load gave

A batch is there once its marker is, which is one rename. Whatever fails before leaves folders that
no reader takes and that the next attempt of the same batch replaces. One writer at a time.

The keys are a side table of 64-bit hashes. A new batch is joined with those of its own days; only
files that hold a hash of the batch are opened, to compare the identifiers themselves. So the answer is exact, and
a batch of new identifiers reads no row of the table.
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.sources.files import delete_folder, folder_names, path_exists, read_small, rename

BATCH = "batch"
_ID = re.compile(r"[A-Za-z0-9_.-]+")


def check_batch_id(batch_id: str) -> str:
    """Batch ids name files."""
    if not _ID.fullmatch(batch_id):
        raise ValueError(f"batch id is not a valid name: {batch_id!r}")
    return batch_id


def _root(path: str) -> str:
    return path.rstrip("/")


def _name(batch_id: str) -> str:
    """Begins with letters, so that no reader takes it for a number."""
    return f"b-{batch_id}"


def answer_of(spark: SparkSession, path: str, batch_id: str) -> dict | None:
    """What the load of a batch answered, or None if the batch is not there."""
    marker = f"{_root(path)}/commits/{_name(batch_id)}"
    return json.loads(read_small(spark, marker)) if path_exists(spark, marker) else None


def commit(spark: SparkSession, path: str, batch_id: str, answer: dict) -> None:
    """Make a batch visible: its marker is written aside and takes its name in one step."""
    aside = f"{_root(path)}/commits-{uuid.uuid4().hex}"
    line = spark.createDataFrame([(json.dumps(answer),)], "value string")
    line.coalesce(1).write.text(aside)
    [part] = [name for name in folder_names(spark, aside) if name.startswith("part-")]
    rename(spark, f"{aside}/{part}", f"{_root(path)}/commits/{_name(batch_id)}")
    delete_folder(spark, aside)


def _visible(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The rows of all marked batches; None if there is none.

    What is left out by name are folders without a marker, which only failures leave.
    """
    folder = f"{_root(path)}/{kind}"
    marked = set(folder_names(spark, f"{_root(path)}/commits"))
    written = {name.removeprefix(f"{BATCH}=") for name in folder_names(spark, folder) if name.startswith(BATCH)}
    if not marked & written:
        return None
    rows = spark.read.parquet(folder)
    unmarked = sorted(written - marked)
    return rows.where(~F.col(BATCH).isin(*unmarked)) if unmarked else rows


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table: the rows of all batches that are there, or None if there are none."""
    rows = _visible(spark, path, "data")
    return None if rows is None else rows.drop(BATCH)


def append(rows: DataFrame, path: str, batch_id: str, date_field: str) -> None:
    """Write the rows of a batch and its keys, in place of what an earlier attempt left. Not visible yet."""
    spark = rows.sparkSession
    data = f"{_root(path)}/data/{BATCH}={_name(batch_id)}"
    writer = rows.hint("rebalance", date_field).write.mode("overwrite")
    writer.partitionBy(date_field).parquet(data)
    keys = (
        spark.read.schema(rows.schema)
        .parquet(data)
        .where(F.col("uuid").isNotNull())
        .select(
            F.col(date_field).cast("date").alias("day"),
            F.xxhash64(F.col("uuid").cast("string")).alias("hash"),
            F.col("_metadata.file_path").alias("file"),
        )
    )
    # In the order of days, so that a look-up for some of them skips the rest by the files' statistics.
    keys = keys.hint("rebalance", "day").sortWithinPartitions("day", "hash")
    keys.write.mode("overwrite").parquet(f"{_root(path)}/keys/{BATCH}={_name(batch_id)}")


def touched_files(spark: SparkSession, path: str, keyed: DataFrame) -> list[str]:
    """The files that may hold identifiers of ``keyed(uuid, day)`` on days of the batch, by their hashes."""
    keys = _visible(spark, path, "keys")
    first, last = keyed.agg(F.min("day"), F.max("day")).first()
    if keys is None or first is None:
        return []
    days = keyed.where(F.col("day").isNotNull()).select(F.col("day").alias("_day")).distinct()
    hashes = keyed.select(F.xxhash64("uuid").alias("_hash")).distinct()
    near = keys.where(F.col("day").between(first, last)).join(days, F.col("day") == F.col("_day"), "left_semi")
    hits = near.join(hashes, F.col("hash") == F.col("_hash"), "left_semi").select("file").distinct()
    return sorted(unquote(row["file"]) for row in hits.collect())


def already_loaded(spark: SparkSession, path: str, keyed: DataFrame, date_field: str) -> DataFrame:
    """Distinct identifiers of the batch that the table holds on days of the batch.

    ``keyed`` should be stored: it is read for the hashes first and for the identifiers then.
    """
    found = touched_files(spark, path, keyed)
    if not found:
        return keyed.select("uuid").where(F.lit(False))
    rows = spark.read.option("basePath", f"{_root(path)}/data").parquet(*found)
    days = keyed.where(F.col("day").isNotNull()).select(F.col("day").alias("_day")).distinct()
    touched = rows.join(days, F.col(date_field).cast("date") == F.col("_day"), "left_semi")
    loaded = touched.select(F.col("uuid").cast("string").alias("uuid"))
    return loaded.join(keyed.select("uuid").distinct(), "uuid", "left_semi").distinct()


def remove_unmarked(spark: SparkSession, path: str) -> list[str]:
    """Delete what failed loads left, while nobody writes; the names of the batches."""
    marked = set(folder_names(spark, f"{_root(path)}/commits"))
    removed = set()
    for kind in ("data", "keys"):
        for name in folder_names(spark, f"{_root(path)}/{kind}"):
            if name.removeprefix(f"{BATCH}=") not in marked:
                delete_folder(spark, f"{_root(path)}/{kind}/{name}")
                removed.add(name.removeprefix(f"{BATCH}=b-"))
    return sorted(removed)
