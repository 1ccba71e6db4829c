"""Batch gate before the warehouse load: all rows of a batch are loaded, or none."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somnotab.session import stage

# Outcomes of a batch.
SUCCESS = "success"
SKIP = "skip"
ERROR = "error"
EXCEPTION = "exception"

# Fixed value: how many offending identifiers are listed.
LISTED = 10

# Why an identifier is refused.
_REPEATED = "repeated"
_LOADED = "loaded"

# Fixed value: what table and column names look like.
_IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")

_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def check_identifier(name: str | None, what: str) -> str:
    """Reject missing or malformed table and column names before any job."""
    if not name:
        raise ValueError(f"{what} is required")
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"{what} is not a valid name: {name!r}")
    return name


def iso_day(value: Column) -> Column:
    """The first ten characters as a date; NULL when they are none."""
    day = F.substring(value.cast("string"), 1, 10)
    return F.when(day.rlike(_ISO_DAY), day.try_cast("date"))


def _filled(value: Column) -> Column:
    return F.coalesce(value.cast("string") != "", F.lit(False))


def keyed_rows(batch: DataFrame, date_field: str) -> DataFrame:
    """``(uuid, day)`` of the rows that have both an identifier and a date text."""
    both = _filled(F.col("uuid")) & _filled(F.col(date_field))
    return batch.where(both).select(
        F.col("uuid").cast("string").alias("uuid"), iso_day(F.col(date_field)).alias("day")
    )


def _listed(offenders: DataFrame, kind: str, count: str, names: str) -> list[DataFrame]:
    """How many stored offenders of a kind there are, and the first few in order; one row each.

    The few are taken by a top-k over the partitions, never by gathering all of them.
    """
    identifiers = offenders.where(F.col("kind") == kind)
    few = identifiers.orderBy("uuid").limit(LISTED)
    return [
        identifiers.agg(F.count("*").alias(count)),
        few.agg(F.sort_array(F.collect_list("uuid")).alias(names)),
    ]


def in_touched_partitions(target: DataFrame, keyed: DataFrame, date_field: str) -> DataFrame:
    """Rows of the target whose date occurs in the batch.

    The first and the last day of the batch are literals, which prune partitions when the plan is
    made; the days between them that the batch does not hold go by a semi-join on the days.
    """
    first, last = keyed.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return target.where(F.lit(False))
    day = F.col(date_field).cast("date")
    days = keyed.where(F.col("day").isNotNull()).select(F.col("day").alias("_batch_day")).distinct()
    return target.where(day.between(first, last)).join(days, day == F.col("_batch_day"), "left_semi")


def already_loaded(keyed: DataFrame, target: DataFrame, date_field: str) -> DataFrame:
    """Distinct identifiers of the batch that the target holds in the batch's own partitions.

    The batch is the side that a join builds on, so a small batch leaves the target where it is;
    its identifiers are distinct before the join, and what meets them is distinct after it.
    """
    touched = in_touched_partitions(target, keyed, date_field)
    loaded = touched.select(F.col("uuid").cast("string").alias("uuid"))
    return loaded.join(keyed.select("uuid").distinct(), "uuid", "left_semi").distinct()


def gate(
    batch: DataFrame, date_field: str, target: DataFrame | None = None, loaded: DataFrame | None = None
) -> DataFrame:
    """One row that says what happens to the batch.

    ``target`` is the table as it stands; a table with a side table of identifiers answers itself, by
    ``loaded``, which of the batch's it holds.

    ``(status, reason, n_rows, n_keyed, n_bad_dates, n_duplicates, duplicates, n_existing,
    existing)``. Checks in order: an unreadable date on a keyed row, no keyed row at all,
    duplicates in the batch, identifiers already loaded, and a date that is missing or
    unreadable on any row. A row with a date and no identifier is no reason to refuse.
    Repeated and loaded identifiers are stored at once, so that the batch and the target are read
    for them only one time; ``session.discard`` of the answer deletes them.
    """
    keyed = keyed_rows(batch, date_field)
    undated = iso_day(F.col(date_field)).isNull()
    both = _filled(F.col("uuid")) & _filled(F.col(date_field))
    totals = batch.agg(
        F.count("*").alias("n_rows"),
        F.count_if(both).alias("n_keyed"),
        F.count_if(both & undated).alias("n_bad_dates"),
        F.count_if(undated).alias("n_undated"),
    )
    repeated = keyed.groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1")
    offenders = repeated.select("uuid", F.lit(_REPEATED).alias("kind"))
    if target is not None:
        loaded = already_loaded(keyed, target, date_field)
    if loaded is not None:
        offenders = offenders.unionAll(loaded.select("uuid", F.lit(_LOADED)))
    offenders = stage(offenders, "offenders")
    parts = [
        totals,
        *_listed(offenders, _REPEATED, "n_duplicates", "duplicates"),
        *_listed(offenders, _LOADED, "n_existing", "existing"),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = ("n_rows", "n_keyed", "n_bad_dates", "n_undated", "n_duplicates", "n_existing")
    one = stacked.agg(
        *[F.max(c).alias(c) for c in counts],
        F.max("duplicates").alias("duplicates"),
        F.max("existing").alias("existing"),
    )
    rules = (
        (F.col("n_bad_dates") > 0, ERROR, "bad_date"),
        (F.col("n_keyed") == 0, SKIP, "no_identifiers"),
        (F.col("n_duplicates") > 0, ERROR, "duplicates_in_batch"),
        (F.col("n_existing") > 0, ERROR, "already_loaded"),
        (F.col("n_undated") > 0, EXCEPTION, "undated_row"),
    )
    status = reason = None
    for test, outcome, why in rules:
        status = F.when(test, outcome) if status is None else status.when(test, outcome)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    answer = one.select(
        status.otherwise(SUCCESS).alias("status"),
        reason.alias("reason"),
        "n_rows",
        "n_keyed",
        "n_bad_dates",
        "n_duplicates",
        "duplicates",
        "n_existing",
        "existing",
    )
    answer.staged_path = offenders.staged_path
    return answer


def shaped_rows(batch: DataFrame, date_field: str, now: datetime) -> DataFrame:
    """Rows as loaded: blanks as NULL, the date as a date, one time stamp per batch.

    ``now`` carries its time zone: a bare time would be read in the zone of the driver.
    """
    if now.tzinfo is None:
        raise ValueError("the time stamp of a batch needs a time zone")
    columns = []
    for field in batch.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name == date_field:
            columns.append(iso_day(column).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            columns.append(F.when(column != "", column).alias(field.name))
        else:
            columns.append(column)
    return batch.select(*columns, F.lit(now).cast("timestamp").alias("migrado"))
