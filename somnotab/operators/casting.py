"""Typing of the unified text columns, with a report of what could be typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.functions import casts
from somnotab.specs.curated import ColumnClasses

NOT_FOUND = "not_found"
NOT_TRANSFORMED = "not_transformed"
TRANSFORMED = "transformed"


def _present(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in df.columns]


def fractional_columns(df: DataFrame, names: list[str]) -> set[str]:
    """Columns holding at least one number with a fraction; one aggregate over all of them."""
    if not names:
        return set()
    doubles = {n: casts.to_double(F.col(f"`{n}`")) for n in names}
    row = df.agg(*[F.max(d != F.floor(d)).alias(n) for n, d in doubles.items()]).first()
    return {n for n in names if row[n]}


def cast_columns(
    df: DataFrame,
    classes: ColumnClasses,
    reference_year: int | None = None,
    date_mode: str = "compat",
) -> DataFrame:
    """The typed table alone; see ``cast_with_failures``."""
    return cast_with_failures(df, classes, reference_year, date_mode)[0]


def cast_with_failures(
    df: DataFrame,
    classes: ColumnClasses,
    reference_year: int | None = None,
    date_mode: str = "compat",
) -> tuple[DataFrame, set[str]]:
    """Type the declared columns; undeclared and absent ones are left alone.

    A whole-number column with a fraction anywhere fails as a whole and stays text, with its
    decimal commas replaced. Finding that out takes one job; without declared whole-number
    columns nothing runs here. The names of the failed columns are what ``transform_report`` needs.
    """
    year = casts.current_year() if reference_year is None else reference_year
    integers = _present(df, classes.integers)
    failed = fractional_columns(df, integers)
    typed = {}
    for name in integers:
        text = F.col(f"`{name}`").cast("string")
        number = casts.to_double(text).try_cast("bigint")
        typed[name] = casts.decimal_point(text) if name in failed else number
    for name in _present(df, classes.doubles):
        typed[name] = casts.to_double(F.col(f"`{name}`").cast("string"))
    dates = _present(df, classes.dates)
    for name in _present(df, classes.strings):
        typed[name] = F.col(f"`{name}`").cast("string")
    # The parts are a column of their own, so that the text is searched once per date.
    parts = {f"_parts_{n}": casts.date_parts(F.col(f"`{n}`").cast("string")) for n in dates}
    frame = df.withColumns(parts) if parts else df
    for name in dates:
        typed[name] = casts.date_from_parts(F.col(f"`_parts_{name}`"), year, date_mode)
    return frame.select(*[typed.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]), failed


def transform_report(
    typed: DataFrame, classes: ColumnClasses, failed: frozenset[str] | set[str] = frozenset()
) -> DataFrame:
    """``(variable, type, status)`` of every declared column.

    A column is transformed when it holds at least one value; ``failed`` names whole-number
    columns that were refused. One aggregate job whatever the number of columns.
    """
    declared = [
        (name, kind)
        for kind, names in (
            ("int", classes.integers),
            ("float", classes.doubles),
            ("datetime", classes.dates),
            ("str", classes.strings),
        )
        for name in names
    ]
    present = [n for n, _ in declared if n in typed.columns]
    counts = typed.agg(
        *[F.max(F.col(f"`{n}`").isNotNull()).alias(n) for n in dict.fromkeys(present)],
        F.count("*").alias("_rows"),
    )
    lines = []
    for name, kind in declared:
        if name not in typed.columns:
            status = F.lit(NOT_FOUND)
        elif name in failed:
            status = F.lit(NOT_TRANSFORMED)
        else:
            status = F.when(F.col(f"`{name}`"), TRANSFORMED).otherwise(NOT_TRANSFORMED)
        lines.append(
            F.struct(
                F.lit(name).alias("variable"), F.lit(kind).alias("type"), status.alias("status")
            )
        )
    return counts.select(F.inline(F.array(*lines)))
