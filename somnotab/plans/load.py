"""JSON batch to the date-partitioned warehouse table."""

from __future__ import annotations

import logging
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from somnotab.operators import ingest
from somnotab.session import discard, stage
from somnotab.sources import warehouse as wh

_log = logging.getLogger(__name__)


def load_batch(
    spark: SparkSession,
    batch: DataFrame,
    warehouse: str,
    table: str,
    date_field: str,
    now: datetime,
    batch_id: str | None = None,
) -> dict:
    """Check the batch and append all of it, or nothing.

    The batch is stored first: the gate checks, and the table gets, exactly the stored rows, and
    the source is read once. ``now`` needs a time zone.
    The answer has the gate's fields and, on success, ``rows_inserted``; it is fixed when the batch
    becomes visible, in one step. Failures before that are answered with the status ``exception`` and leave
    the table as it was; failures behind it, while tidying up, change nothing and go to the log. A batch
    of an id that is loaded already is not loaded again: its answer is given again, with ``repeated``.
    """
    try:
        ingest.check_identifier(table, "table")
        ingest.check_identifier(date_field, "date_field")
        batch_id = wh.check_batch_id(uuid.uuid4().hex if batch_id is None else batch_id)
    except ValueError as problem:
        return {"status": ingest.ERROR, "reason": str(problem)}
    if now.tzinfo is None:
        return {"status": ingest.ERROR, "reason": "now needs a time zone"}
    path = f"{warehouse.rstrip('/')}/{table}"
    stored = []
    try:
        known = wh.answer_of(spark, path, batch_id)
        if known is not None:
            return known | {"repeated": True}
        frozen = stage(batch, "batch")
        stored.append(frozen)
        keyed = ingest.keyed_rows(frozen, date_field)
        gated = ingest.gate(frozen, date_field, loaded=wh.already_loaded(spark, path, keyed, date_field))
        stored.append(gated)
        answer = gated.first().asDict()
        if answer["status"] == ingest.SUCCESS:
            answer["rows_inserted"] = answer["n_rows"]
            wh.append(ingest.shaped_rows(frozen, date_field, now), path, batch_id, date_field)
            wh.commit(spark, path, batch_id, answer)
        return answer
    except Exception as problem:
        # The marker decides, not the step that failed.
        return _answer(spark, path, batch_id) or {"status": ingest.EXCEPTION, "reason": str(problem)}
    finally:
        for frame in stored:
            _tidied(frame)


def _answer(spark: SparkSession, path: str, batch_id: str) -> dict | None:
    try:
        return wh.answer_of(spark, path, batch_id)
    except Exception:
        _log.exception("marker of batch %s could not be read", batch_id)
        return None


def _tidied(frame: DataFrame) -> None:
    try:
        discard(frame)
    except Exception:
        _log.exception("stored rows %s could not be deleted", frame.staged_path)
