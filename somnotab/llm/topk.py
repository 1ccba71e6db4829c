"""Exact search by inner product: exhaustive term-at-a-time accumulation.

Components are integers, floor(64 x). A dimension is a term; the vectors of a block that are not zero
there are its postings. For a block of queries and a block of vectors, every term's postings are scattered,
weighted by the queries that ask for the term, into a dense array of scores. Where nearly every vector has
nearly every term, terms are added sixteen at a time. The best of each row are selected by partition, and the lists
of the blocks are merged.

Blocks are packed rows of bounded size. ``GROUP`` blocks of vectors meet ``QUERY_GROUP`` blocks of queries in one
task, so its input stays the same however many vectors there are: a vector travels once for each group of
queries, a query once for each group of vectors. The query set, one row in twenty, is stated by the task, so
the work is queries times vectors. No list of all queries is broadcast.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do
rows with a null id; vectors of different lengths meet as if the shorter ended in
zeros; rows that repeat an id are vectors of their own, and a query row never meets itself; a
repeated query id has one list over all its rows; ties go to the smaller id. Components so large
that a score leaves 64 bits are outside the contract.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somnotab.llm import storage

SCALE = 64
BLOCK = 8192
QUERY_BLOCK = 1024
#: Blocks of vectors, and of queries, that meet in one task.
GROUP = 2
QUERY_GROUP = 4
#: Share of components that are not zero below which terms are scattered one by one.
SPARSE = 0.25
EVERY = 20
K = 20
#: Terms added at once, and the sums up to which floating point is exact.
_TERMS = 16
_EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.monotonically_increasing_id().alias("row"))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as floor(64 x); shorter rows end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _pack(ids, column, rows) -> list:
    components = _matrix(column)
    as_bytes = [np.asarray(a.to_numpy(zero_copy_only=False), dtype=np.int64).tobytes() for a in (ids, rows)]
    return [
        pa.array([components.shape[1]], pa.int32()),
        *[pa.array([b], pa.binary()) for b in as_bytes],
        pa.array([components.tobytes()], pa.binary()),
    ]


_PACKED = ["width", "ids", "rows", "components"]


def _blocks(rows: DataFrame, size: int, groups: int, name: str) -> DataFrame:
    """Packed rows of at most ``size`` vectors, dealt over ``groups`` groups by a hash of the row."""
    numbered = rows.select("vec_id", "x", "row", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias(name))

    def pack(table):
        number, made = table.column(name)[0].as_py(), []
        for i in range(0, table.num_rows, size):
            part = table.slice(i, size)
            columns = [part.column(c).combine_chunks() for c in ("vec_id", "x", "row")]
            made.append(pa.Table.from_arrays([pa.array([number], pa.int32()), *_pack(*columns)], [name, *_PACKED]))
        return pa.concat_tables(made)

    return numbered.groupBy(name).applyInArrow(pack, f"{name} int, width int, ids binary, rows binary, components binary")


def scattered(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of all pairs, term after term: the postings of a term, weighted by the queries that have it."""
    scores = np.zeros((len(queries), len(vectors)), dtype=np.int64)
    for t in range(min(queries.shape[1], vectors.shape[1])):
        asking, postings = np.flatnonzero(queries[:, t]), np.flatnonzero(vectors[:, t])
        weights = vectors[postings, t]
        for q in asking:
            scores[q, postings] += queries[q, t] * weights
    return scores


def accumulated(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact scores of all pairs. Sparse vectors, and sums beyond floating point's exact range, are scattered."""
    width = min(queries.shape[1], vectors.shape[1])
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, width)
    if bound >= _EXACT or np.count_nonzero(vectors) < SPARSE * vectors.size:
        return scattered(queries, vectors)
    scores = np.zeros((len(queries), len(vectors)))
    for t in range(0, width, _TERMS):
        end = min(width, t + _TERMS)
        scores += queries[:, t:end].astype(np.float64) @ vectors[:, t:end].astype(np.float64).T
    return scores.astype(np.int64)


def _best(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to smaller ids."""
    cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else _NONE
    found = np.flatnonzero((row >= cut) & (row > _NONE))
    return found[np.lexsort((ids[found], -row[found]))[:k]]


def _unpacked(table: pa.Table):
    """(ids, rows, components) of every packed block."""
    for block in table.select(_PACKED).to_pylist():
        ids, rows, flat = (np.frombuffer(block[c], np.int64) for c in ("ids", "rows", "components"))
        yield ids, rows, flat.reshape(len(ids), block["width"])


def _merged(k: int, one, other):
    """The k best of two lists of (ids, scores) of one query row."""
    ids, scores = (np.concatenate(x) for x in zip(one, other, strict=True))
    best = _best(scores, ids, k)
    return ids[best], scores[best]


def _searcher(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        held = list(_unpacked(vectors))
        out = [[], [], []]
        for ids, rows, asked in _unpacked(queries):
            for j in range(0, len(ids), 256):
                lists = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids[j : j + 256])
                for c_ids, c_rows, components in held:
                    scores = accumulated(asked[j : j + 256], components)
                    for q, own in zip(*np.nonzero(rows[j : j + 256, None] == c_rows[None, :]), strict=True):
                        scores[q, own] = _NONE
                    for q, row in enumerate(scores):
                        best = _best(row, c_ids, k)
                        lists[q] = _merged(k, lists[q], (c_ids[best], row[best]))
                for q, (found, values) in enumerate(lists):
                    out[0].append(np.full(len(found), ids[j + q], dtype=np.int64))
                    out[1].append(found)
                    out[2].append(values)
        arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
        return pa.Table.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (rows whose id ``every`` divides)."""
    rows = storage.staged(usable(vectors, id_col, vector_col), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    groups, query_groups = (
        max(1, -(-frame.count() // (size * many)))
        for frame, size, many in ((rows, BLOCK, GROUP), (asked, QUERY_BLOCK, QUERY_GROUP))
    )

    def each(number, name):
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)

    held = _blocks(rows, BLOCK, groups, "place").select("*", each(query_groups, "turn"))
    queries = _blocks(asked, QUERY_BLOCK, query_groups, "turn").select("*", each(groups, "place"))
    found = (
        queries.groupBy("turn", "place")
        .cogroup(held.groupBy("turn", "place"))
        .applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
