"""Derived columns, final projection, version stamp and publication of the curated table."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.functions import units
from somnotab.specs.curated import FINAL_COLUMNS, FORMATS, MEASURES, ColumnClasses, Measure

# Fixed value: prefix and time format of the version stamp.
STAMP_PREFIX = "Extraido en: "
STAMP_FORMAT = "%Y-%m-%d : %H:%M:%S"


def with_decimal_age(df: DataFrame, strict: bool = False) -> DataFrame:
    age = units.age_in_years(
        F.col("edad_anos"), F.col("edad_meses"), F.col("edad_dias"), strict
    )
    return df.withColumn("edad_anos_decimal", age)


def with_clean_units(df: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    return df.withColumns(
        {m.unit_column: units.clean_unit(F.col(m.unit_column)) for m in measures}
    )


def with_converted_measures(
    df: DataFrame, measures: tuple[Measure, ...] = MEASURES
) -> DataFrame:
    """Add each measure in its target unit; unit columns must be clean."""
    return df.withColumns(
        {m.target: units.convert(F.col(m.name), F.col(m.unit_column), m) for m in measures}
    )


def unknown_units(df: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """``(measure, unit, n)`` of cleaned units outside each measure's known list.

    Known and missing units are dropped before the grouping, which is partial on the map side,
    so only the few unknown spellings are shuffled.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("measure"),
                F.when(~F.col(m.unit_column).isin(*m.known_units), F.col(m.unit_column)).alias(
                    "unit"
                ),
            )
            for m in measures
        ]
    )
    lines = df.select(F.inline(F.filter(found, lambda line: line["unit"].isNotNull())))
    return lines.groupBy("measure", "unit").agg(F.count("*").alias("n"))


def curated_columns(df: DataFrame, columns: tuple[str, ...] = FINAL_COLUMNS) -> DataFrame:
    """The final columns in order; a missing one is an analysis error."""
    return df.select(*columns)


def version_stamp(now: datetime) -> str:
    return STAMP_PREFIX + now.strftime(STAMP_FORMAT)


def with_version(df: DataFrame, now: datetime) -> DataFrame:
    """One stamp per run: the caller reads the clock once."""
    return df.withColumn("version_control", F.lit(version_stamp(now)))


def check_percent_columns(percents: tuple[str, ...], doubles: tuple[str, ...]) -> None:
    outside = [c for c in percents if c not in doubles]
    if outside:
        raise ValueError(f"percent columns that are not declared as float: {outside}")


def percent_to_fraction(
    df: DataFrame, percents: tuple[str, ...], doubles: tuple[str, ...]
) -> DataFrame:
    """Percent columns divided by 100; absent columns are skipped. The input is not changed."""
    check_percent_columns(percents, doubles)
    present = [c for c in percents if c in df.columns]
    return df.withColumns({c: F.col(c) / 100 for c in present}) if present else df


def format_manifest(
    df: DataFrame, classes: ColumnClasses, percents: tuple[str, ...]
) -> DataFrame:
    """``(position, column, type, pattern)`` for each column of a declared class.

    Derived from the column list alone; no data is read.
    """
    members = {
        "strings": classes.strings,
        "integers": classes.integers,
        "percents": percents,
        "doubles": classes.doubles,
        "dates": classes.dates,
    }
    rows = []
    for position, column in enumerate(df.columns):
        match = next((f for f in FORMATS if column in members[f[0]]), None)
        if match is not None:
            rows.append((position, column, match[1], match[2]))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, pattern string"
    )


def row_uuid(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``uuid``.

    Without keys it is random and drawn again whenever the plan is recomputed, so write the
    result once and read it back. With keys it is a digest of them in the same format, and
    stays the same over retries and runs; NULL and blank are different keys, and rows with equal
    keys share an identifier, so keys must name a row.
    """
    if keys is None:
        return df.withColumn("uuid", F.expr("uuid()"))
    typed = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    lengths = [F.coalesce(F.length(F.col(k).cast("string")), F.lit(-1)).cast("string") for k in keys]
    digest = F.sha2(F.concat_ws(":", *lengths, *typed), 256)
    parts = [
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(
            F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1)),
            F.substring(digest, 18, 3),
        ),
        F.substring(digest, 21, 12),
    ]
    return df.withColumn("uuid", reduce(lambda a, b: F.concat(a, F.lit("-"), b), parts))
