"""What could not be read, recognised, cut or found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somnotab.operators import labelling as lb
from somnotab.specs.exams import EXTRACTORS

MISSING_FIELD = "missing_field"

# Log level of each reason.
LEVELS = {
    lb.UNSUPPORTED: "WARNING",
    lb.UNREADABLE: "CRITICAL",
    lb.UNKNOWN_TYPE: "INFO",
    lb.NO_SLICE: "ERROR",
    lb.NO_EXTRACTOR: "WARNING",
    MISSING_FIELD: "WARNING",
}


def _own_fields() -> Column:
    """Names of the row's own fields, in the order of ``record``."""
    names = None
    for extractor in EXTRACTORS:
        mine = (F.col("exam_type") == extractor.exam) & (F.col("ext") == extractor.ext)
        own = F.array(*[F.lit(c) for c in extractor.columns])
        names = F.when(mine, own) if names is None else names.when(mine, own)
    return names


def audit(extracted: DataFrame) -> DataFrame:
    """``(doc_id, exam_type, level, reason, field)`` from the output of ``extract_all``.

    One narrow scan: a row yields either its own failed status or one line per missing field. A record has at
    least one field, so a row without a place is one without a record.
    """
    values = extracted.select(
        "doc_id", "exam_type", "ext", "status", F.posexplode_outer("record").alias("place", "value")
    )
    failed = F.col("place").isNull()
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return (
        values.where(F.col("value").isNull())
        .withColumn("reason", F.when(failed, F.col("status")).otherwise(MISSING_FIELD))
        .withColumn("field", F.when(~failed, F.get(_own_fields(), F.col("place"))))
        .select("doc_id", "exam_type", level[F.col("reason")].alias("level"), "reason", "field")
    )


def audit_counts(lines: DataFrame) -> DataFrame:
    """Number of audit lines per exam type, reason and field."""
    return lines.groupBy("exam_type", "level", "reason", "field").agg(
        F.count("*").alias("n")
    )
