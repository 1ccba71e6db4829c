"""A mix of sources that comes to target weights, with a cap on repetitions. DataFrame functions only.

Capped water-filling: every source's share of the whole is its weight, clamped at ``max_epochs``
times what it has; what a clamped source cannot give is shared anew by weight until no target is
above its cap. Sampling is seeded: a target of r times its source takes every document floor(r)
times, and once more those that come first in the order of a keyed hash of their id, until the
target is used up; the document on the border is taken in part, so taken words meet the target to
within one word. ``sampled`` repeats whole rows only: it takes the document on the border or leaves it,
whichever comes nearer to the target (of two equally near, it takes it).

Defined cases: a null text has no words; a null source is a source, ordered last; a source
without words has the target 0, and documents without words are taken 0 times; repeated rows are
documents of their own; those that share an id are told apart by a hash of their text, and those alike
in that, too, are interchangeable. Results depend on the rows and the seed only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somnotab.llm import storage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
SPACES = "[\\x20\\x09-\\x0D]+"


def word_count(text):
    """Runs of anything but ASCII white space: the pieces of a split less the empty ones at its ends."""
    pieces = F.size(F.split(text, SPACES))
    edges = text.rlike("^[\\x20\\x09-\\x0D]").cast("int") + text.rlike("[\\x20\\x09-\\x0D]\\z").cast("int")
    return F.when(F.length(text) > 0, pieces - edges).otherwise(0).cast("long")


def measured(documents: DataFrame, id_col: str, text_col: str, source_col: str, seed: str = SEED) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(word_count(F.col(text_col)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.xxhash64(text_col).alias("text_key"),
    )


def numbered(sources: DataFrame) -> DataFrame:
    """A gapless number for each source in code point order, null last, without one task for all.

    A range sort puts the sources into ordered partitions; a number is the place in the partition
    plus the rows of the partitions before it.
    """
    ordered = storage.staged(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()),
        "mixing-order",
    ).withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(offsets, "part").withColumn("number", place).drop("part", "at", "offset")


def water_level(sources: DataFrame, max_epochs: int) -> float | None:
    """The level at which every target is min(cap, level * weight) and the targets sum to the whole.

    Each round is one aggregate over the sources; a source that is clamped stays clamped, since the
    level only rises. None for a corpus without words.
    """
    level = None
    while True:
        clamped = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("whole"),
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("given"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weight"),
        ).first()
        if not row["whole"] or not row["weight"]:
            return level
        raised = float(row["whole"] - row["given"]) / float(row["weight"])
        if level is not None and raised <= level:
            return level
        level = raised


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target; one row per source."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    level = water_level(sources, max_epochs)
    share = F.least(F.lit(level or 0.0) * F.col("weight"), F.col("cap").cast("double"))
    return storage.staged(sources.select("source", "source_size", share.alias("target")), "mixing-targets")


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target and ``taken`` words of every row; ``source`` and ``key`` follow,
    then ``text_key`` and ``copies``, the times that the row is taken if only whole rows are.

    The order within a source is by key, cut into 4096 runs of keys: whole runs are summed first,
    so that a source of any size is spread over many tasks.
    """
    rows = storage.staged(measured(documents, id_col, text_col, source_col, seed), "mixing")
    goals = targets(rows, weights, max_epochs)
    rows = rows.withColumn("run", F.substring("key", 1, 3))
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.withColumn("whole", F.floor(F.try_divide("target", "source_size")))
    goals = goals.withColumn(
        "rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    )
    quotas = (
        runs.withColumn("run_begin", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("s"), F.col("run").alias("r"), "run_begin", "source_size", "target", "whole", "rest")
    )
    within = (
        Window.partitionBy("source", "run")
        .orderBy("key", "doc_id", "size", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r"))
    )
    left = F.greatest(F.lit(0), F.col("rest") - F.col("run_begin") - F.col("before"))
    extra = F.least(F.col("size"), left)
    taken = F.coalesce(F.col("whole") * F.col("size") + extra, F.lit(0)).cast("long")
    # Once more if half of the row or more lies before the border.
    again = ((F.col("size") > 0) & (2 * left >= F.col("size"))).cast("long")
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("whole") + again, F.lit(0))).otherwise(0).cast("long")
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "key", "text_key", copies.alias("copies")
    )


def sampled(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``documents``, whole and unchanged, repeated as the mix takes them.

    Rows are met again by id, source and a hash of their text. Of rows alike in all three, of which the mix
    takes no equal number, those first by a hash of the other columns are taken once more.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    own_id, own_source, own_key, key, each, more, copy, place = storage.fresh(
        documents, "id", "source", "own_key", "key", "each", "more", "copy", "place"
    )
    alike = mix(documents, **options).groupBy("doc_id", "source", "text_key")
    alike = alike.agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0")
    taken = storage.staged(
        alike.select(
            F.col("doc_id").alias(own_id),
            F.col("source").alias(own_source),
            F.col("text_key").alias(own_key),
            F.floor(F.col("total") / F.col("n")).cast("int").alias(each),
            (F.col("total") % F.col("n")).alias(more),
        ),
        "mixing-copies",
    )
    keyed = documents.withColumn(key, F.xxhash64(text_col))

    def met(rows):
        return keyed.join(
            rows,
            F.col(id_col).eqNullSafe(F.col(own_id))
            & F.col(source_col).cast("string").eqNullSafe(F.col(own_source))
            & (F.col(key) == F.col(own_key)),
        )

    shown = met(taken.where(F.col(each) > 0)).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(each))))
    # Only rows alike on the border of their source have a rest: one such group for each source at most.
    others = [c for c in documents.columns if c not in (id_col, text_col, source_col)]
    order = Window.partitionBy(id_col, source_col, key).orderBy(F.xxhash64(F.lit(0), *others))
    rest = met(taken.where(F.col(more) > 0)).withColumn(place, F.row_number().over(order)).where(F.col(place) <= F.col(more))
    return shown.select(*documents.columns).unionAll(rest.select(*documents.columns))
