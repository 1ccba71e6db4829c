"""Incremental extraction: new reports appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from somnotab.plans import extraction
from somnotab.plans.extraction import extracted_reports


def append_new_reports(
    reports: DataFrame, output: str, checkpoint: str, exams: tuple[str, ...] | None = None
) -> StreamingQuery:
    """Extract the reports that a stream has not seen yet and append their records.

    Extraction keeps no state between rows, so the batch transformation runs unchanged on a
    stream; the checkpoint makes a repeated run append nothing twice.
    """
    return (
        extracted_reports(reports, exams)
        .writeStream.format("parquet")
        .partitionBy("exam_type", "ext")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_new_reports(
    reports: DataFrame,
    folder: str,
    checkpoint: str,
    name: str = "stream",
    exams: tuple[str, ...] | None = None,
) -> StreamingQuery:
    """Result files and audit lines of the reports that a stream has not seen yet.

    Each batch of the stream is a run of the whole flow, named after the stream and the batch. A batch
    that fails halfway is repeated under its name by the next start, and replaces what it left in
    result files and audit, so both hold each report once. ``name`` tells streams that write to one folder apart.
    """

    def write(batch: DataFrame, number: int) -> None:
        extraction.run(batch, folder, exams, run_id=f"{name}-{number}")

    return (
        reports.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
