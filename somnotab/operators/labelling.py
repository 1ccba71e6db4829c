"""Reports to labelled slices: normalise, classify, one row per label, cut the section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somnotab.functions import text as tx
from somnotab.specs.exams import EXAMS, EXTRACTORS, HINT_WORDS, OPENING, READABLE, UNKNOWN, Exam

# Outcome of a (report, label) row.
OK = "ok"
UNSUPPORTED = "unsupported_ext"
UNREADABLE = "unreadable"
UNKNOWN_TYPE = "unknown_type"
NO_SLICE = "no_slice"
NO_EXTRACTOR = "no_extractor"


def label_openings(key: Column, exams: tuple[Exam, ...] = EXAMS) -> Column:
    """What begins with the opening word in a lower-cased normal form, as far as a phrase can reach."""
    longest = max(len(phrase) for exam in exams for phrase in exam.phrases)
    return tx.openings(key, OPENING, max(longest, len(OPENING)))


def label_hits(key: Column, exams: tuple[Exam, ...] = EXAMS, openings: Column | None = None) -> Column:
    """The exam labels in recognition order, NULL for those not found in a lower-cased normal form.

    Phrases that begin with the opening word are looked for in ``openings``, if there is a column of them.
    """
    hits = []
    for exam in exams:
        opened = openings is not None and all(p.startswith(OPENING) for p in exam.phrases)
        found = tx.contains_any(openings if opened else key, exam.phrases)
        hits.append(F.when(found, F.lit(exam.label)))
    return F.array(*hits)


def exam_labels(hits: Column) -> Column:
    """Array of the exam labels that were hit, in recognition order.

    A report may carry several labels; one without any gets the unknown label. The hits must be
    a column: searches inside ``array_compact`` would not be compiled.
    """
    found = F.array_compact(hits)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNKNOWN)))


def exam_slice(
    label: Column, normal: Column, exams: tuple[Exam, ...] = EXAMS, key: Column | None = None
) -> Column:
    """The section of the text that belongs to the label; empty when it cannot be cut."""
    cut = None
    for exam in exams:
        section = tx.slice_between(normal, exam.start, exam.end, key)
        matches = label == exam.label
        cut = F.when(matches, section) if cut is None else cut.when(matches, section)
    return cut


def with_normal_text(reports: DataFrame) -> DataFrame:
    """Replace ``text`` by its normal form ``normal``."""
    return reports.withColumn("normal", tx.normalize(F.col("text"))).drop("text")


def with_labels(reports: DataFrame) -> DataFrame:
    """Replace ``text`` by its normal form and add ``labels`` and the marker key ``_marker_key``.

    ``labels`` is NULL for files that are not read or could not be decoded. Every phrase holds
    one of a few hint words, and one search of the raw text for these tells most foreign
    documents apart: they are unknown without being normalised (``normal`` stays NULL). The
    lower-cased key is a column of its own, so that all phrase tests share it.
    """
    readable = F.lower("ext").isin(*READABLE) & F.col("text").isNotNull()
    hinted = F.col("text").rlike(tx.unfolded_pattern(HINT_WORDS))
    return (
        reports.withColumn("readable", F.coalesce(readable, F.lit(False)))
        .withColumn("normal", F.when(F.col("readable") & hinted, tx.normalize(F.col("text"))))
        .withColumn("_ascii", tx.is_ascii(F.col("normal")))
        .withColumn(
            "_key",
            F.when(F.col("_ascii"), F.lower("normal")).otherwise(tx.phrase_key(F.col("normal"))),
        )
        .withColumn("_openings", label_openings(F.col("_key")))
        .withColumn("_hits", label_hits(F.col("_key"), openings=F.col("_openings")))
        .withColumn(
            "labels",
            F.when(F.col("_key").isNotNull(), exam_labels(F.col("_hits"))).when(
                F.col("readable"), F.array(F.lit(UNKNOWN))
            ),
        )
        .withColumn(
            "_marker_key",
            F.when(F.col("_ascii"), F.col("_key")).otherwise(tx.marker_key(F.col("_key"))),
        )
        .drop("_ascii", "_key", "_openings", "_hits", "readable", "text")
    )


def explode_labels(labelled: DataFrame) -> DataFrame:
    """One row per (report, label) in recognition order; unread files keep one row."""
    others = [c for c in labelled.columns if c != "labels"]
    return labelled.select(
        *others, F.posexplode_outer("labels").alias("label_pos", "exam_type")
    )


def outcome(ext: Column, label: Column, section: Column) -> Column:
    """Why a (report, label) row can or cannot be extracted."""
    dispatched = F.array(*[F.lit(f"{e.exam}.{e.ext}") for e in EXTRACTORS])
    return (
        F.when(~F.coalesce(ext.isin(*READABLE), F.lit(False)), UNSUPPORTED)
        .when(label.isNull(), UNREADABLE)
        .when(label == UNKNOWN, UNKNOWN_TYPE)
        .when(section.isNull(), NO_SLICE)
        .when(~F.array_contains(dispatched, F.concat_ws(".", label, ext)), NO_EXTRACTOR)
        .otherwise(OK)
    )


def label_and_slice(reports: DataFrame) -> DataFrame:
    """``reports(doc_id, path, ext, text)`` to one row per (report, label).

    Adds ``label_pos``, ``exam_type``, ``section`` and ``status``. Every step works on one row,
    so the scan's partitioning is kept and nothing is shuffled. The normal form is computed
    once, before the explode, and dropped after the section is cut.
    """
    exploded = explode_labels(with_labels(reports)).withColumn("ext", F.lower("ext"))
    section = exam_slice(F.col("exam_type"), F.col("normal"), key=F.col("_marker_key"))
    cut = exploded.withColumn("_cut", section).drop("_marker_key")
    section = tx.blank_to_null(F.col("_section"))
    return (
        computed_once(cut.drop("normal"), "_cut", "_section")
        .withColumn("section", section)
        .drop("_section")
        .withColumn("status", outcome(F.col("ext"), F.col("exam_type"), F.col("section")))
    )


def computed_once(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Rename an expensive column across a fence.

    A filter on a computed column is moved below the projection and computes it again. It is
    not moved below a generator, so the column passes through one that yields its single value.
    """
    others = [c for c in frame.columns if c != column]
    return frame.select(*others, F.explode(F.array(column)).alias(name))
