"""Reports to records: the folder-to-result-files flow."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.operators.audit import audit, audit_counts
from somnotab.operators.extraction import extract_all
from somnotab.operators.labelling import NO_EXTRACTOR, OK, label_and_slice
from somnotab.session import discard, stage
from somnotab.sources import sinks
from somnotab.specs.exams import EXTRACTORS


def extracted_reports(reports: DataFrame, exams: tuple[str, ...] | None = None) -> DataFrame:
    """Every report through labelling and extraction; one scan, no shuffle.

    ``exams`` limits extraction to some types (the scheduled run uses the live ones); the
    others end with the status they would have without an extractor.
    """
    chosen = tuple(e for e in EXTRACTORS if exams is None or e.exam in exams)
    slices = label_and_slice(reports)
    if exams is not None:
        off = (F.col("status") == OK) & ~F.col("exam_type").isin(*exams)
        slices = slices.withColumn("status", F.when(off, NO_EXTRACTOR).otherwise(F.col("status")))
    return extract_all(slices, chosen)


@dataclass(frozen=True)
class Outputs:
    results: list[str]
    audit: str
    counts: list
    run_id: str


def run(
    reports: DataFrame,
    folder: str,
    exams: tuple[str, ...] | None = None,
    run_id: str | None = None,
) -> Outputs:
    """Extract, then add result files and audit lines to those of earlier runs.

    A run that failed halfway is repeated under its ``run_id`` and replaces what it left; without
    one, every call is a run of its own. An exam type that only the failed attempt had stays.
    The texts are read by one job, which stores the extracted rows in the shared folder by exam
    and file type; each result file reads its own partition of them, the audit all of them.
    """
    stored = stage(extracted_reports(reports, exams), "extracted", ("exam_type", "ext"))
    lines = audit(stored)
    audit_path = f"{folder.rstrip('/')}/audit"
    run_id = uuid.uuid4().hex if run_id is None else run_id
    results = sinks.write_results(stored, folder, run_id)
    sinks.write_run(lines, audit_path, run_id)
    counts = audit_counts(lines).collect()
    discard(stored)
    return Outputs(results, audit_path, counts, run_id)
