"""Writers: result files, unified table, staging area, warehouse table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.operators import workbook
from somnotab.operators.curation import format_manifest, percent_to_fraction
from somnotab.operators.extraction import records_of, with_missing_text
from somnotab.session import discard, stage
from somnotab.sources.files import swap_in
from somnotab.specs.curated import PERCENT_COLUMNS, ColumnClasses
from somnotab.specs.exams import EXTRACTORS, Extractor

#: Partition column of result files and audit lines.
RUN = "run"

# Fixed value: the baseline report's result files go by another name than its label.
_RESULT_NAMES = {"BASAL": "psg"}


def result_name(extractor: Extractor) -> str:
    exam = _RESULT_NAMES.get(extractor.exam, extractor.exam.lower())
    return f"resultados_{exam}_{extractor.ext}"


def _csv(df: DataFrame, mode: str):
    return (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Add the rows of a run to a Parquet table, in place of what the same run wrote before."""
    writer = rows.withColumn(RUN, F.lit(run_id)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def write_results(extracted: DataFrame, folder: str, run_id: str) -> list[str]:
    """Add one delimited table per extractor that has records; returns their paths.

    The rows of a run lie in a folder of their own, and replace those that the same run left.
    ``extracted`` should be stored, not computed, as it is read once per extractor.
    """
    present = {
        (r["exam_type"], r["ext"])
        for r in extracted.where("record is not null").select("exam_type", "ext").distinct().collect()
    }
    written = []
    for extractor in EXTRACTORS:
        if (extractor.exam, extractor.ext) not in present:
            continue
        columns = extractor.columns + (["fuente"] if extractor.with_source else [])
        records = records_of(extracted, extractor.exam, extractor.ext)
        named = records.select(*[f"`{c}`" for c in columns])
        path = f"{folder.rstrip('/')}/{result_name(extractor)}.csv"
        rows = with_missing_text(named, extractor.columns).withColumn(RUN, F.lit(run_id))
        writer = _csv(rows, "overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(RUN).csv(path)
        written.append(path)
    return written


def write_unified(unified: DataFrame, path: str) -> None:
    """Written beside its place and moved there when complete: a failure leaves the last one."""
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    _csv(unified, "error").csv(fresh)
    swap_in(unified.sparkSession, fresh, path)


def write_workbooks(classified: DataFrame, folder: str) -> tuple[str, str]:
    """Accepted records and rejected files, from one evaluation of the pivot."""
    stored = stage(classified, "workbooks")
    records = f"{folder.rstrip('/')}/resultados_xlsx.csv"
    refused = f"{folder.rstrip('/')}/archivos_no_cumplen_criterios.csv"
    _csv(workbook.accepted(stored), "overwrite").csv(records)
    _csv(workbook.rejected(stored), "overwrite").csv(refused)
    discard(stored)
    return records, refused


def publish(
    curated: DataFrame,
    folder: str,
    classes: ColumnClasses,
    percents: tuple[str, ...] = PERCENT_COLUMNS,
) -> None:
    """Replace the staging copy of the table and its column format manifest."""
    scaled = percent_to_fraction(curated, percents, classes.doubles)
    scaled.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/data")
    manifest = format_manifest(curated, classes, percents)
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/formats")
