"""Profiles that are kept up to date: partial aggregates for each part of a table, merged on reading.

A part, such as a month, is measured once. Its state is one line for each column and, for columns whose
values are listed, their counts; a change in one part measures that part again and reads nothing of
the others. Counts, smallest and largest values, samples and frequencies merge exactly; means are sums over counts.
Distinct values merge exactly if the counts of all columns are kept, else by HyperLogLog sketches,
whose relative error has a standard deviation of 1.04 / sqrt(2 ** ``LG_BUCKETS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.operators import profile

#: 4096 buckets: a standard error of 1.6 %.
LG_BUCKETS = 12
PART = "part"


def states(df: DataFrame, part: str, order_by: list[str]) -> DataFrame:
    """``(part, variable, position, type, n_rows, n_present, min, max, sum, n_clean, sample, sketch)``.

    One line for each part and column, by one aggregate. ``part`` and ``order_by`` are columns of the
    table; ``sample`` holds the order and the first usable value as text.
    """
    fields = [f for f in df.schema.fields if f.name != part]
    measures, lines = [F.count("*").alias("_rows")], []
    for i, field in enumerate(fields):
        value, number = profile._value(field), profile._is_number(field)
        clean = profile._clean(field).cast("double") if number else F.lit(None).cast("double")
        key = F.struct(*[profile._column(k) for k in order_by])
        candidate = F.when(profile._usable(field), F.struct(key.alias("key"), value.cast("string").alias("value")))
        text = value.cast("string")
        made = {
            "n_present": F.count(value),
            "min": F.min(clean),
            "max": F.max(clean),
            "sum": F.sum(clean),
            "n_clean": F.count(clean),
            "sample": F.min(candidate),
            "sketch": F.hll_sketch_agg(text, LG_BUCKETS),
        }
        measures += [c.alias(f"_{name}{i}") for name, c in made.items()]
        lines.append(
            F.struct(
                F.lit(field.name).alias("variable"),
                F.lit(i).alias("position"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.col("_rows").alias("n_rows"),
                *[F.col(f"_{name}{i}").alias(name) for name in made],
            )
        )
    grouped = df.groupBy(profile._column(part).alias(PART)).agg(*measures)
    return grouped.select(PART, F.inline(F.array(*lines)))


def frequency_states(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """``(part, variable, value, n)`` of the listed columns."""
    fields = {f.name: f for f in df.schema.fields}
    pairs = F.array(
        *[F.struct(F.lit(n).alias("variable"), profile._value(fields[n]).cast("string").alias("value")) for n in columns]
    )
    rows = df.select(profile._column(part).alias(PART), F.inline(pairs)).where(F.col("value").isNotNull())
    return rows.groupBy(PART, "variable", "value").agg(F.count("*").alias("n"))


def merged(stored: DataFrame) -> DataFrame:
    """The summary of all parts, as ``profile.summary`` gives it, with the sketched ``n_distinct``."""
    return stored.groupBy("variable", "position", "type").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_present").alias("n_present"),
        F.min("min").alias("min"),
        F.try_divide(F.sum("sum"), F.sum("n_clean")).alias("mean"),
        F.max("max").alias("max"),
        F.min("sample")["value"].alias("sample"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("n_distinct"),
    )


def merged_frequencies(stored: DataFrame) -> DataFrame:
    """``(variable, value, n)`` of all parts."""
    return stored.groupBy("variable", "value").agg(F.sum("n").alias("n"))


def profile_of(stored: DataFrame, frequencies: DataFrame, categories: list[str], exact: bool = True) -> DataFrame:
    """The profile table of all parts.

    ``exact`` takes distinct values from the frequencies, which then must hold all columns.
    """
    lines = merged(stored)
    distinct = None if exact else lines.select("variable", "n_distinct")
    return profile.shown(lines.drop("n_distinct"), merged_frequencies(frequencies), categories, distinct)
