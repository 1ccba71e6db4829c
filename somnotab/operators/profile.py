"""Column profile of a table.

Two scans, however many columns. One global aggregate gives counts, min / mean / max and
samples. A frequency table ``(variable, value, n)``, grouped with map-side partial aggregation
and stored once, gives distinct counts for all columns and category frequencies for the listed
ones, so there is no distinct aggregate per column. No task ever sees all values
of a variable: the ten most frequent ones are picked by a ranked filter, which Spark pre-limits
in every partition, and the others are a difference of two sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somnotab.session import discard, stage

# Fixed values of the profile.
SENTINEL = -9999
TOP = 10
OTHERS = "OTROS"
NOT_APPLICABLE = "N/A"
NO_NUMBER = "nan"
NEVER_CATEGORICAL = "fecha"
LARGE = 1e6
_NUMBER_TYPES = "^(tinyint|smallint|int|bigint|float|double|decimal.*)$"

#: Values that a frequent-item sketch keeps for each column, and bytes of them that are broadcast.
TRACKED = 10_000
BROADCAST_BYTES = 32 << 20


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is_number(f)]


def _value(field: T.StructField) -> Column:
    """The column with NaN as NULL and one zero."""
    column = _column(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column + F.lit(0.0))
    return column


def _two_decimals(number: Column) -> Column:
    """Exact binary value, rounded half to even."""
    return F.call_function("format_number", number, F.lit("0.00"))


def display_number(value: Column) -> Column:
    """Two decimals, or scientific notation above a million in absolute value."""
    number = value.cast("double")
    size = F.abs(number)
    exponent = F.floor(F.log10(size))
    digits = F.rint(size / F.pow(F.lit(10.0), exponent - 2))
    carried = digits >= 1000
    mantissa = _two_decimals(F.when(carried, F.lit(1.0)).otherwise(digits / 100))
    power = F.format_string("%02d", exponent + carried.cast("int"))
    sign = F.when(number < 0, "-").otherwise("")
    infinite = size == float("inf")
    return (
        F.when(infinite, F.concat(sign, F.lit("INF")))
        .when(size > LARGE, F.concat(sign, mantissa, F.lit("E+"), power))
        .otherwise(_two_decimals(number))
    )


def display_percent(part: Column, whole: Column) -> Column:
    percent = F.try_divide(part, whole) * 100
    share = _two_decimals(percent)
    return F.concat(F.coalesce(share, F.lit(NO_NUMBER)), F.lit("%"))


def month_histogram(df: DataFrame, date_column: str) -> DataFrame:
    """``(month, n)`` in month order; rows without a date are left out."""
    month = F.trunc(F.col(date_column).cast("date"), "month")
    return (
        df.where(F.col(date_column).isNotNull())
        .groupBy(month.alias("month"))
        .agg(F.count("*").alias("n"))
        .orderBy("month")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of the non-null values, most frequent first, ties by value."""
    return (
        df.where(_column(column).isNotNull())
        .groupBy(_column(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def _clean(field: T.StructField) -> Column:
    """What the statistics of a number count: neither missing nor the sentinel."""
    value = _value(field)
    return F.when(value != SENTINEL, value)


def _usable(field: T.StructField) -> Column:
    """Whether a value may be shown as a sample."""
    value = _value(field)
    return value.isNotNull() & (value != 0) if _is_number(field) else value.isNotNull()


def summary(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One line per column from one global aggregate.

    ``(variable, position, type, n_rows, n_present, min, mean, max, sample)``. The statistics
    skip the sentinel; they are NULL for columns that are not numeric. The sample is the first
    value that is neither NULL nor zero in the order given, NULL when there is none; without an
    order it is the smallest such value.
    """
    measures, lines = [F.count("*").alias("_rows")], []
    for i, field in enumerate(df.schema.fields):
        value = _value(field)
        if _is_number(field):
            clean = _clean(field)
            measures += [
                F.min(clean).cast("double").alias(f"_min{i}"),
                F.avg(clean).alias(f"_mean{i}"),
                F.max(clean).cast("double").alias(f"_max{i}"),
            ]
        stats = [
            (F.col(f"_{s}{i}") if _is_number(field) else F.lit(None).cast("double")).alias(s)
            for s in ("min", "mean", "max")
        ]
        measures.append(F.count(value).alias(f"_present{i}"))
        key = F.struct(*[_column(k) for k in order_by]) if order_by else value
        candidate = F.when(_usable(field), F.struct(key.alias("key"), value.alias("value")))
        measures.append(F.min(candidate)["value"].cast("string").alias(f"_sample{i}"))
        lines.append(
            F.struct(
                F.lit(field.name).alias("variable"),
                F.lit(i).alias("position"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.col("_rows").alias("n_rows"),
                F.col(f"_present{i}").alias("n_present"),
                *stats,
                F.col(f"_sample{i}").alias("sample"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*lines)))


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(variable, value, n)`` of the non-null values of all columns, values as text."""
    names = df.columns if columns is None else columns
    fields = {f.name: f for f in df.schema.fields}
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("variable"), _value(fields[n]).cast("string").alias("value")
            )
            for n in names
        ]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count("*").alias("n"))
    )


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    """``(variable, n_distinct)``."""
    return frequencies.groupBy("variable").agg(F.count("*").alias("n_distinct"))


def _best(frequencies: DataFrame, top: int) -> DataFrame:
    """``(variable, best, kept)``: the ``top`` most frequent values in order, and their sum."""
    order = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    ranked = frequencies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = F.sort_array(F.collect_list(F.struct("rank", "value", "n")))
    return ranked.groupBy("variable").agg(best.alias("best"), F.sum("n").alias("kept"))


def _totals(frequencies: DataFrame) -> DataFrame:
    """``(variable, n_distinct, total)``."""
    return frequencies.groupBy("variable").agg(
        F.count("*").alias("n_distinct"), F.sum("n").alias("total")
    )


def _lines(top: int) -> Column:
    """The best values and, when they count for something, the others as one last line."""
    rest = F.col("total") - F.col("kept")
    others = F.struct(F.lit(top + 1).alias("rank"), F.lit(OTHERS).alias("value"), rest.alias("n"))
    return F.when(rest > 0, F.concat("best", F.array(others))).otherwise(F.col("best"))


def _text(top: int) -> Column:
    """The lines as ``"value: n | value: n"``, quotes included."""
    texts = F.transform(
        _lines(top), lambda line: F.concat_ws(": ", line["value"], line["n"].cast("string"))
    )
    return F.concat(F.lit('"'), F.array_join(texts, " | "), F.lit('"'))


def top_frequencies(frequencies: DataFrame, top: int = TOP) -> DataFrame:
    """``(variable, rank, value, n)``: the most frequent values, the others as one last line.

    The line of the others is only there when they count for something. The table is read
    twice, so one that is dear to compute should be stored.
    """
    joined = _best(frequencies, top).join(_totals(frequencies), "variable")
    return joined.select("variable", F.inline(_lines(top)))


def frequency_texts(frequencies: DataFrame, top: int = TOP) -> DataFrame:
    """``(variable, frequencies)`` as ``"value: n | value: n"``, quotes included."""
    joined = _best(frequencies, top).join(_totals(frequencies), "variable")
    return joined.select("variable", _text(top).alias("frequencies"))


def sketch_bound(total: int, tracked: int = TRACKED) -> int:
    """The count that a value which the sketch does not return cannot exceed.

    Spark's sketch has a map of 2 ** ceil(log2(tracked / 0.75)) items, whose error is at most 3.5 / map size of all rows;
    it returns what is certainly above that error, so a value left out has at most twice as many rows.
    """
    return math.floor(7 * total / 2 ** math.ceil(math.log2(tracked / 0.75)))


def _texts(df: DataFrame, names: list[str]) -> DataFrame:
    fields = {f.name: f for f in df.schema.fields}
    return df.select(*[_value(fields[n]).cast("string").alias(f"v{i}") for i, n in enumerate(names)])


def most_frequent(
    df: DataFrame, columns: list[str] | None = None, top: int = TOP, tracked: int = TRACKED
) -> DataFrame:
    """What ``top_frequencies`` says, without grouping by every distinct value where that can be avoided.

    A first pass keeps a sketch of fixed size for each column; a second one counts only the values that the
    sketches name, exactly. A column is done if its last listed value has more rows than any other value
    can have: by the sketch's bound, or because fewer rows are left over. Columns in which nothing stands
    out, such as identifiers, cannot be decided that way by any summary; those alone are grouped in full.
    ``session.discard`` of the answer deletes the counts that it reads.
    """
    names = df.columns if columns is None else columns
    values = _texts(df, names)
    sketches = [
        F.expr(f"approx_top_k(v{i}, {tracked}, {tracked}) filter (where v{i} is not null)").alias(f"s{i}")
        for i in range(len(names))
    ]
    totals = [F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]
    line = [
        F.struct(
            F.lit(name).alias("variable"),
            F.col(f"n{i}").alias("total"),
            F.transform(f"s{i}", lambda x: x["item"]).alias("candidates"),
        )
        for i, name in enumerate(names)
    ]
    named = stage(values.agg(*sketches, *totals).select(F.inline(F.array(*line))), "candidates")
    candidates = named.select("variable", F.explode("candidates").alias("value"))
    size = candidates.agg(F.sum(F.octet_length("value") + 64)).first()[0] or 0
    pairs = values.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"v{i}").alias("value")) for i, n in enumerate(names)]))
    )
    side = F.broadcast(candidates) if size <= BROADCAST_BYTES else candidates
    counts = pairs.join(side, ["variable", "value"]).groupBy("variable", "value").agg(F.count("*").alias("n"))
    counts = stage(counts, "frequent")
    best = counts.groupBy("variable").agg(
        F.sum("n").alias("counted"), F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, top).alias("n")
    )
    undecided = []
    for row in named.drop("candidates").join(best, "variable", "left").collect():
        counted, largest = row["counted"] or 0, row["n"] or []
        others = min(row["total"] - counted, sketch_bound(row["total"], tracked))
        if others > 0 and (len(largest) < top or largest[-1] <= others):
            undecided.append(row["variable"])
    frequencies = counts.where(~F.col("variable").isin(*undecided)) if undecided else counts
    if undecided:
        frequencies = frequencies.unionAll(value_frequencies(df, undecided))
    joined = _best(frequencies, top).join(named.select("variable", "total"), "variable")
    lines = stage(joined.select("variable", F.inline(_lines(top))), "top")
    discard(named)
    discard(counts)
    return lines


def top_values(df: DataFrame, column: str, top: int, tracked: int = TRACKED) -> DataFrame:
    """``(value, n)`` of the ``top`` most frequent values as text, ties by value."""
    lines = most_frequent(df, [column], top, tracked)
    found = lines.where(F.col("rank") <= top).select("value", "n")
    found.staged_path = lines.staged_path
    return found


def presence(df: DataFrame) -> DataFrame:
    """``(variable, n_rows, n_present)`` from one global count."""
    counts = [F.count(_value(f)).alias(f"_present{i}") for i, f in enumerate(df.schema.fields)]
    lines = [
        F.struct(
            F.lit(name).alias("variable"),
            F.col("_rows").alias("n_rows"),
            F.col(f"_present{i}").alias("n_present"),
        )
        for i, name in enumerate(df.columns)
    ]
    return df.agg(F.count("*").alias("_rows"), *counts).select(F.inline(F.array(*lines)))


def missing_share(df: DataFrame) -> DataFrame:
    """``(variable, n_missing, missing_share)``."""
    absent = F.col("n_rows") - F.col("n_present")
    return presence(df).select(
        "variable",
        absent.alias("n_missing"),
        display_percent(absent, F.col("n_rows")).alias("missing_share"),
    )


def distinct_share(df: DataFrame) -> DataFrame:
    """``(variable, n_distinct, distinct_share)``; columns without values count zero."""
    return presence(df).join(distinct_counts(value_frequencies(df)), "variable", "left").select(
        "variable",
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        display_percent(F.coalesce("n_distinct", F.lit(0)), F.col("n_rows")).alias(
            "distinct_share"
        ),
    )


def categorical(columns: list[str]) -> list[str]:
    """Columns that may be listed by category: dates by name are not."""
    return [c for c in columns if NEVER_CATEGORICAL not in c.lower()]


def profile(
    df: DataFrame, categories: list[str], order_by: list[str] | None = None
) -> DataFrame:
    """The profile table, one line per column in column order.

    ``categories`` are the columns whose frequencies are listed, save those named after a date.
    The frequency table is stored at once, by one scan; ``session.discard`` of the profile deletes
    it when the profile itself has been stored.
    """
    frequencies = stage(value_frequencies(df), "frequencies")
    table = shown(summary(df, order_by), frequencies, categories)
    table.staged_path = frequencies.staged_path
    return table


def shown(lines: DataFrame, frequencies: DataFrame, categories: list[str], distinct: DataFrame | None = None) -> DataFrame:
    """The profile table of a summary and a frequency table.

    ``distinct`` gives ``(variable, n_distinct)`` where the frequency table does not hold all columns.
    """
    listed = frequencies.where(F.col("variable").isin(*categorical(categories)))
    counted = _totals(frequencies)
    if distinct is not None:
        counted = distinct.join(counted.drop("n_distinct"), "variable", "left")
    counted = counted.join(_best(listed, TOP), "variable", "left")
    absent = F.col("n_rows") - F.col("n_present")
    unique = F.coalesce("n_distinct", F.lit(0))

    def share(count: Column) -> Column:
        percent = display_percent(count, F.col("n_rows"))
        return F.concat(count.cast("string"), F.lit(" ("), percent, F.lit(")"))

    def number(name: str) -> Column:
        text = F.coalesce(display_number(F.col(name)), F.lit(NO_NUMBER))
        return F.when(F.col("type").rlike(_NUMBER_TYPES), text).otherwise(NOT_APPLICABLE)

    return (
        lines.join(counted, "variable", "left")
        .orderBy("position")
        .select(
            "variable",
            "type",
            F.col("n_present").alias("count"),
            share(unique).alias("unique"),
            F.coalesce(_text(TOP), F.lit(NOT_APPLICABLE)).alias("frequencies"),
            share(absent).alias("missing"),
            number("min").alias("min"),
            number("mean").alias("mean"),
            number("max").alias("max"),
            F.coalesce("sample", F.lit(NOT_APPLICABLE)).alias("sample"),
        )
    )
