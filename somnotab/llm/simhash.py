"""Near copies by SimHash fingerprints that differ in at most two bits.

Fingerprints are made in batches; what follows works on distinct fingerprints only. Each is cut into
five blocks. Two within distance two share at least three whole blocks, so all choices of three
blocks are join keys, and only fingerprints that meet another under a key go on. Within a key two
members are verified through a fingerprint halfway between them: each offers itself and every
change of one bit outside the shared blocks, and members that offer the same are at most two
bits apart, while members within two bits always share an offer. Each member is linked to the
smallest that shares its offer, so a group of m near copies gives O(m) links, never all pairs, and
no group is gathered in one place: an offer is shared by at most 65 fingerprints.

Links become components by alternating large-star and small-star steps over stored edge tables.

Defined cases: a null or empty text has the fingerprint 0 and is linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows are one group; a null id never names
a component unless its component has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somnotab.llm import storage

SHINGLE = 3
SEED = 42
_CHUNK = 1 << 15
#: Bits of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed integer: bit set if set in more than half of the shingles' hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > n)
    return _signed(int.from_bytes(bits.tobytes(), "big"))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, and a hash of the text that tells rows of one id apart."""
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def compute(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = {t: fingerprint(t) for t in set(texts)}
            fps = pa.array([known[t] for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fps], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(compute, f"doc_id {kind}, text_key long, fp long")


def _block_masks() -> list[tuple[int, list[int]]]:
    """For every choice of three blocks: the mask of their bits, and the single bits outside."""
    edges = np.cumsum((0, *BLOCKS))
    blocks = [range(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    masks = []
    for chosen in combinations(range(len(BLOCKS)), 3):
        inside = {bit for b in chosen for bit in blocks[b]}
        mask = sum(1 << bit for bit in inside)
        masks.append((_signed(mask), [_signed(1 << bit) for bit in range(64) if bit not in inside]))
    return masks


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, over distinct ``fp``: enough of them to connect all within two bits."""
    masks = _block_masks()
    keys = F.array(
        *[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, (m, _) in enumerate(masks)]
    )
    keyed = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.choice", "key.block")
    sharing = F.count("*").over(Window.partitionBy("choice", "block"))
    close = keyed.withColumn("n", sharing).where("n > 1")
    free = F.array(*[F.array(*[F.lit(b) for b in bits]) for _, bits in masks])
    changes = F.concat(F.array(F.lit(0).cast("long")), F.element_at(free, F.col("choice") + 1))
    offers = close.select("fp", F.explode(changes).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("offer"))
    least = F.min("fp").over(Window.partitionBy("offer"))
    met = offers.distinct().withColumn("v", least).where("fp > v")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
    return met.where(apart <= 2).select(F.col("fp").alias("u"), "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of its component."""
    edges = storage.staged(edges.select("u", "v"), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = storage.staged(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        edges = storage.staged(small.distinct(), "small-star")
        # Star steps settle when the edges, compared as a set, no longer change.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable) of every row."""
    rows = storage.staged(fingerprints(documents, id_col, text_col), "fingerprints")
    nodes = storage.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    rooted = components(links(nodes.select("fp")))
    labelled = nodes.join(rooted.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = labelled.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = storage.staged(labelled.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_key")


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group stays, whole and unchanged: the one with its smallest id.

    Rows that repeat that id are told apart by their text; of rows alike in both one stays.
    """
    own, key, place = storage.fresh(documents, "own", "key", "place")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("first")
    kept = groups(documents, id_col, text_col).groupBy("root").agg(first)
    kept = kept.select(F.col("first.doc_id").alias(own), F.col("first.text_key").alias(key))
    kept = storage.staged(kept, "representatives").withColumnRenamed(key, f"{key}_")
    keyed = documents.withColumn(key, F.xxhash64(text_col))
    rows = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(key) == F.col(f"{key}_")), "left_semi")
    others = [c for c in documents.columns if c not in (id_col, text_col)]
    order = Window.partitionBy(id_col, key).orderBy(F.xxhash64(F.lit(0), *others))
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*documents.columns)
