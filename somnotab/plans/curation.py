"""Result files to the curated table and the staging area."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from somnotab import session
from somnotab.operators import casting, curation, profile
from somnotab.operators.schema import union_by_name
from somnotab.sources import sinks, tables
from somnotab.specs.curated import BASAL_CLASSES

STUDY_DATE = "fecha_estudio"


def unify(frames: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Union by column name with a row identifier."""
    return curation.row_uuid(union_by_name(frames), keys)


def unify_files(
    spark: SparkSession,
    paths: list[str],
    output: str,
    keys: list[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Unify result files, write the unified table and read it back.

    ``multi_line`` is for files with line ends in quoted values; it is kept for the way back.
    With ``keys`` identifiers are the same in every run; without, they are random and reading back
    fixes them.
    """
    unified = curation.row_uuid(tables.read_results(spark, paths, output, multi_line), keys)
    sinks.write_unified(unified, output)
    return tables.read_table(spark, output, multi_line)


def typed(unified: DataFrame, reference_year: int, date_mode: str = "compat") -> DataFrame:
    return casting.cast_columns(unified, BASAL_CLASSES, reference_year, date_mode)


def curate(
    unified: DataFrame, now: datetime, date_mode: str = "compat", strict_age: bool = False
) -> DataFrame:
    """Text columns to the curated table: typed, converted, projected, stamped.

    Row by row throughout; nothing is shuffled.
    """
    return _finished(_cleaned(typed(unified, now.year, date_mode), strict_age), now)


def _cleaned(frame: DataFrame, strict_age: bool) -> DataFrame:
    return curation.with_clean_units(curation.with_decimal_age(frame, strict_age))


def _finished(cleaned: DataFrame, now: datetime) -> DataFrame:
    frame = curation.with_converted_measures(cleaned)
    return curation.with_version(curation.curated_columns(frame), now)


@dataclass(frozen=True)
class Curated:
    """The curated table with what a run reports about it."""

    table: DataFrame
    transformed: DataFrame
    unknown_units: DataFrame
    months: DataFrame
    profile: DataFrame
    staged: tuple[DataFrame, ...]

    def discard(self) -> None:
        """Delete the stored intermediate tables, once all that is wanted has been written."""
        for frame in self.staged:
            session.discard(frame)


def curate_with_reports(
    unified: DataFrame,
    now: datetime,
    categories: list[str] | None = None,
    date_mode: str = "compat",
    strict_age: bool = False,
) -> Curated:
    """The curated table, what could be typed, unknown units, studies per month, and the profile.

    The typed table is stored once, with clean units; table and reports all start from it. The
    profile lists the values of ``categories``, by default of every text column.
    """
    frame, failed = casting.cast_with_failures(unified, BASAL_CLASSES, now.year, date_mode)
    cleaned = session.stage(_cleaned(frame, strict_age), "curated")
    table = _finished(cleaned, now)
    texts = [name for name, kind in table.dtypes if kind == "string"]
    described = profile.profile(table, texts if categories is None else categories)
    return Curated(
        table,
        casting.transform_report(cleaned, BASAL_CLASSES, failed),
        curation.unknown_units(cleaned),
        profile.month_histogram(table, STUDY_DATE),
        described,
        (cleaned, described),
    )


def publish(curated: DataFrame, folder: str) -> None:
    sinks.publish(curated, folder, BASAL_CLASSES)
