"""Fill-in-the-middle: a text is cut in three and written with its middle last.

A text is a sequence of units, by default single code points. ``regexp_count`` gives their number n;
two hashed places, drawn from 0 to n, are the ends of prefix and middle. The row's own pattern
spells the two lengths as counted possessive quantifiers, so one match, without any backtracking,
captures the three parts and one replacement writes them in their new order. A replacement of the same kind
gives the text back. Only built-in functions on single rows: one scan, no shuffle, no Python.

Units are counted in runs of ``_RUN`` first and one by one only in what is left behind the last run, so that a
long text does not become an array of its characters.

Defined cases: a null or empty text is plain, as is one that holds a sentinel; a null id is hashed as
an empty one; repeated rows are cut alike; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "(?s:.)"
PLAIN_FROM = 90
SPM_BELOW = 20
_RUN = 1024


def units(text: Column, unit: str = UNIT) -> Column:
    """How many units a text has, matched from left to right."""
    run = F.lit(f"(?:{unit}){{{_RUN}}}+")
    rest = F.regexp_replace(text, run, F.lit(""))
    return (F.regexp_count(text, run).cast("long") * _RUN + F.regexp_count(rest, F.lit(unit))).cast("long")


def draws(identifier: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearranged(text: Column, prefix_units: Column, middle_units: Column, form: Column, unit: str = UNIT) -> Column:
    """Prefix, middle and suffix in one match, written with sentinels in the order of the form."""
    counted = F.concat(
        F.lit(f"\\A((?:{unit}){{"), prefix_units.cast("string"),
        F.lit(f"}}+)((?:{unit}){{"), middle_units.cast("string"), F.lit("}+)((?s:.*+))\\z"),
    )
    order = F.when(form == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")).otherwise(
        F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    )
    return F.regexp_replace(text, counted, order)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Sentinels are found at once: the parts hold none."""
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    counted = rows.select("doc_id", "text", units(F.col("text"), unit).alias("n"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    ends = counted.select("*", form.alias("form"), (h1 % (F.col("n") + 1)).alias("a"), (h2 % (F.col("n") + 1)).alias("b"))
    cut = ends.select("doc_id", "text", "n", "form", F.least("a", "b").alias("a"), F.abs(F.col("a") - F.col("b")).alias("m"))
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.col("a")).alias("prefix_chars"),
        F.when(moved, F.col("m")).alias("middle_chars"),
        F.when(moved, rearranged(F.col("text"), F.col("a"), F.col("m"), F.col("form"), unit))
        .otherwise(F.col("text"))
        .alias("output"),
    )


def report(transformed: DataFrame) -> DataFrame:
    """Digests of every output and of the text rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
