"""Benchmark passages in training text, by a distributed positional inverted index. DataFrame functions only.

The index stores postings (term, document, position) of training tokens. Which terms it holds follows
from the test set: every window of a test item is looked up through its rarest terms, so only these
need postings. Corpus-wide frequencies of all test terms say which they are. A window is
found by taking the list of its rarest term, shifting it by the term's place in the window, and
intersecting it with the shifted list of the next rarest; what is left is compared word by word with
the neighbourhood that the rarest term's postings keep. One more posting marks the end of
every document and holds its length.

The probe side of both scans is a set of 64-bit term hashes. It is broadcast in slices of at most
``TERMS_PER_SCAN`` terms, one scan each, so what is broadcast is bounded whatever the test set;
two terms that share a hash only add candidates, which the comparison refuses.

Defined cases: null texts have no words; an item without words is never found; one with fewer words
than a window is a single window; rows with equal texts have equal results; items that repeat
count once; a null item id counts for hits but not among the items; an empty benchmark finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somnotab.llm import storage

WINDOW = 10
TERMS_PER_SCAN = 400_000
#: What separates words, and the capitals that are folded.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\n"


def folded(text):
    """A-Z in lower case and nothing else. ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def pieces(text):
    """The words, with an empty piece before or after them where the text begins or ends otherwise."""
    return F.split(folded(text), SEPARATOR)


def words(text):
    return F.filter(pieces(text), lambda w: w != "")


def phrases_of(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (``phrase_id``, ``phrase``), and the items that hold them."""
    own = items.select(F.col(id_col).alias("item_id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    windows = (
        own.where(F.size("w") > 0)
        .withColumn("start", F.explode(starts))
        .select("item_id", F.expr(f"slice(w, start + 1, {window})").alias("phrase"))
        .distinct()
    )
    windows = storage.staged(windows, "test-windows")
    phrases = storage.staged(
        windows.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()),
        "test-phrases",
    )
    return phrases, windows.join(phrases, "phrase").select("phrase_id", "item_id")


def _probed(tokens: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Tokens whose hash is among the terms: one scan for each slice of terms."""
    slices = max(1, -(-n_terms // TERMS_PER_SCAN))
    parts = [
        tokens.join(F.broadcast(terms.where(F.pmod("term", F.lit(slices)) == s)), "term")
        for s in range(slices)
    ]
    return reduce(DataFrame.unionAll, parts)


def _tokens(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with the document's key and words; Spark keeps only the columns asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.size("pieces") - F.col("edges")
    return (
        documents.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text).alias("k1"),
            F.xxhash64(F.lit("second"), text).alias("k2"),
            F.concat(pieces(text), F.array(F.lit(END))).alias("pieces"),
            (
                text.rlike("^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]").cast("int")
                + text.rlike("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]\\z").cast("int")
                + 1
                + (F.length(text) == 0).cast("int")
            ).alias("edges"),
        )
        .select("doc_id", "k1", "k2", "pieces", size.alias("n_words"), F.posexplode("pieces").alias("pos", "piece"))
        .withColumn("term", F.xxhash64("piece"))
    )


def frequencies(documents: DataFrame, phrases: DataFrame, text_col: str) -> DataFrame:
    """How often every term of the test set occurs in the training text, all of it."""
    terms = storage.staged(
        phrases.select(F.explode("phrase").alias("piece")).select(F.xxhash64("piece").alias("term")).distinct(),
        "test-terms",
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = documents.select(F.explode(pieces(text)).alias("piece")).select(F.xxhash64("piece").alias("term"))
    return _probed(tokens, terms, terms.count()).groupBy("term").agg(F.count("*").alias("n"))


def anchors_of(phrases: DataFrame, counted: DataFrame) -> DataFrame:
    """The rarest and next rarest distinct term of every phrase that can occur, and their places."""
    placed = phrases.select("phrase_id", F.posexplode("phrase").alias("place", "piece"))
    placed = placed.groupBy("phrase_id", "piece", F.xxhash64("piece").alias("term")).agg(F.min("place").alias("place"))
    rarest = Window.partitionBy("phrase_id").orderBy(F.coalesce("n", F.lit(0)), "piece")
    ranked = (
        placed.join(counted, "term", "left")
        .withColumn("rank", F.row_number().over(rarest))
        .withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("phrase_id")))
    )
    kept = ranked.where((F.col("rank") <= 2) & (F.col("least") > 0))
    return storage.staged(kept.select("phrase_id", "term", "place", "rank"), "test-anchors")


def build_index(documents: DataFrame, anchors: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """Postings of the anchor terms and of every document's end, stored in the shared folder.

    Postings of leading terms keep the ``radius`` words on either side, from position ``begin``.
    """
    terms = anchors.groupBy("term").agg(F.max(F.col("rank") == 1).alias("leads"))
    end = anchors.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term"), F.lit(False).alias("leads"))
    terms = storage.staged(terms.unionAll(end), "index-terms")
    found = _probed(_tokens(documents, id_col, text_col), terms, terms.count())
    begin = F.greatest(F.col("pos") - radius, F.lit(0))
    around = F.expr(f"slice(pieces, greatest(pos - {radius}, 0) + 1, {2 * radius + 1})")
    return storage.staged(
        found.select(
            "term", "doc_id", "k1", "k2", "pos", "n_words", "leads",
            F.when(F.col("leads"), begin).alias("begin"),
            F.when(F.col("leads"), around).alias("around"),
        ),
        "positional-index",
    )


def _lead_candidates(index: DataFrame, phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    lead = anchors.where(F.col("rank") == 1).join(phrases, "phrase_id")
    lead = lead.select("phrase_id", "phrase", "term", F.col("place"))
    return index.where("leads").join(lead, "term")


def exact(index: DataFrame, phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """k1, k2, start, width, phrase_id of every occurrence of a phrase."""
    second = anchors.where(F.col("rank") == 2).select("phrase_id", F.col("term").alias("t2"), F.col("place").alias("p2"))
    shifted = (
        _lead_candidates(index, phrases, anchors)
        .join(second, "phrase_id", "left")
        .select(
            "phrase_id", "phrase", "k1", "k2", "begin", "around", "t2",
            (F.col("pos") - F.col("place")).alias("start"),
            (F.col("pos") - F.col("place") + F.col("p2")).alias("at2"),
        )
        .where("start >= 0")
    )
    lists = index.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("term").alias("t"), F.col("pos").alias("at"))
    met = (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")) & (F.col("t2") == F.col("t")) & (F.col("at2") == F.col("at"))
    pairs = shifted.where("t2 is not null").join(lists, met, "left_semi")
    alone = shifted.where("t2 is null")
    same = F.expr("slice(around, start - begin + 1, size(phrase)) = phrase")
    return (
        pairs.unionAll(alone)
        .where(F.col("start") >= F.col("begin"))
        .where(same)
        .select("k1", "k2", "start", F.size("phrase").alias("width"), "phrase_id")
    )


def near(index: DataFrame, phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """Proximity: every term of the phrase, in any order, in the neighbourhood of its rarest term."""
    together = F.size(F.array_except("phrase", "around")) == 0
    return _lead_candidates(index, phrases, anchors).where(together).select("doc_id", "k1", "k2", "pos", "phrase_id")


def search(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    proximity: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit, ``items`` (sorted as strings) and the document's key, one row per document.

    With ``proximity`` also ``near_items``: items of which no window occurs, but all words of one stand together
    in some order, each less than a window's width from the rarest of them.
    """
    phrases, members = phrases_of(benchmark, item_col, item_text_col, window)
    anchors = anchors_of(phrases, frequencies(documents, phrases, text_col))
    index = build_index(documents, anchors, window - 1, id_col, text_col)
    matches = storage.staged(exact(index, phrases, anchors).distinct(), "matches")
    covered = (
        matches.select("k1", "k2", "start", "width").distinct()
        .select("k1", "k2", F.explode(F.expr("sequence(start, start + width - 1)")).alias("pos"))
        .distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    )
    items = (
        matches.select("k1", "k2", "phrase_id").distinct().join(members, "phrase_id")
        .groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = covered.join(items, ["k1", "k2"], "left")
    if proximity:
        together = near(index, phrases, anchors).select("k1", "k2", "phrase_id").distinct().join(members, "phrase_id")
        together = together.groupBy("k1", "k2").agg(F.collect_set(F.col("item_id").cast("string")).alias("together"))
        found = found.join(together, ["k1", "k2"], "full")
    found = storage.staged(found, "contaminated")
    ends = index.where(F.col("term") == F.xxhash64(F.lit(END))).select("doc_id", "k1", "k2", "n_words")
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    rows = ends.join(found, ["k1", "k2"], "left")
    near_items = [F.array_sort(F.array_except(F.coalesce("together", none), items)).alias("near_items")] if proximity else []
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        items.alias("items"),
        *near_items,
        "k1",
        "k2",
    )


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without an occurrence of any window, whole and unchanged."""
    k1, k2 = storage.fresh(documents, "k1", "k2")
    found = search(documents, benchmark, **options).where("n_hit > 0")
    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    text = F.coalesce(F.col(options.get("text_col", "text")), F.lit(""))
    keyed = documents.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit("second"), text))
    return keyed.join(found, [k1, k2], "left_anti").select(*documents.columns)
