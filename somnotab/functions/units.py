"""Column functions for ages and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from somnotab.specs.curated import Measure


def age_in_years(years: Column, months: Column, days: Column, strict: bool = False) -> Column:
    """Decimal age. Unknown parts count as zero, so a wholly unknown age is 0.0.

    ``strict`` gives NULL instead when all three parts are unknown.
    """
    zero = F.lit(0.0)
    total = (
        F.coalesce(years, zero)
        + F.coalesce(months, zero) / 12
        + F.coalesce(days, zero) / 365.25
    )
    return F.when(F.coalesce(years, months, days).isNotNull(), total) if strict else total


def clean_unit(unit: Column) -> Column:
    return F.trim(F.lower(unit))


def convert(value: Column, unit: Column, measure: Measure) -> Column:
    """Value in the measure's target unit; NULL for an unknown or missing unit."""
    known = F.coalesce(value, F.lit(0.0)) if measure.null_is_zero else value
    result = None
    for scale in measure.scales:
        scaled = known
        if scale.times != 1:
            scaled = scaled * scale.times
        if scale.over != 1:
            scaled = scaled / scale.over
        test = unit.isin(*scale.units)
        result = F.when(test, scaled) if result is None else result.when(test, scaled)
    return result
