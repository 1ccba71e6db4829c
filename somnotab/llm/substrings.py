"""Long repeated passages, found through anchors at the positions of a difference cover.

A passage is a window of 35 consecutive words. Windows of 15 words are hashed at positions whose
remainder modulo 21 is in {0, 1, 4, 14, 16}: for any two positions some shift below 21 takes both
into this set, so two equal passages always share an anchor, whatever their offsets. Only passages
that hold an anchor seen more than once can repeat; these few are hashed in full (the anchor
extended to the whole passage) and counted across the corpus.

Both counts go by hash, so every row is small and no group is gathered. A hash that several rows
of one Arrow batch share is known to repeat: one row asks for it under the hash, the others are dealt
out under altered hashes with their answer attached. A passage in a third of all documents thus sends
one row per batch to the task that counts it, not one per document.

Hashes of passages have 96 bits, anchors 64; anchors only choose candidates. Texts travel compressed.

Defined cases: a null text has no words; a text shorter than a passage is kept whole; repeated rows and
equal texts repeat each other, so all their passages go; a passage that overlaps its own copy in the
same document counts as repeated; documents are known by a 128-bit hash of their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from somnotab.llm import storage

PASSAGE = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = PASSAGE - PERIOD + 1
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4F
_SALT = np.uint64(0x165667B19E3779F9)
#: Word hashes remembered by a task before it starts afresh.
_MEMO = 1 << 18
#: Rows per batch handed back to Spark.
_ROWS = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 12, 2 * self.n)
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.cumprod(np.full(self.n, np.uint64(self.base)))
            self.down = np.cumprod(np.full(self.n, np.uint64(inverse)))
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of the high bits over all of them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _windows(values: np.ndarray, width: int, starts: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of the windows of ``width`` values at ``starts``."""
    up, down = powers.upto(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return _mixed((sums[starts + width] - sums[starts]) * down[starts])


def _word_values(words: list[bytes], memo: _WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def _text_key(text: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(text)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _anchor_starts(n_words: int) -> np.ndarray:
    starts = np.arange(max(0, n_words - ANCHOR + 1))
    return starts[np.isin(starts % PERIOD, COVER)] if n_words >= PASSAGE else starts[:0]


def _ask(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes to count under, and what each row brings: see the head of this module."""
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    known = (counts[inverse] > 1) | (times > 1)
    asks = np.zeros(len(hashes), dtype=bool)
    asks[first] = True
    spread = _mixed(hashes ^ (np.arange(len(hashes), dtype=np.uint64) * _SALT))
    return np.where(asks, hashes, spread), np.where(known, 2, 1).astype(np.int8)


def _emit(columns: list[np.ndarray], names: list[str]):
    for i in range(0, len(columns[0]), _ROWS):
        arrays = [pa.array(c[i : i + _ROWS].view(np.int64) if c.dtype == np.uint64 else c[i : i + _ROWS]) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _anchor_rows(batches):
    memo, powers = _WordHashes(), _Powers(_BASE)
    for batch in batches:
        texts: dict[bytes, int] = {}
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text:
                texts[text] = texts.get(text, 0) + 1
        hashes, k1, k2, pos, times = [], [], [], [], []
        for text, n in texts.items():
            words = text.split()
            starts = _anchor_starts(len(words))
            if not len(starts):
                continue
            hashes.append(_windows(_word_values(words, memo), ANCHOR, starts, powers))
            a, b = _text_key(text)
            k1.append(np.full(len(starts), a, dtype=np.int64))
            k2.append(np.full(len(starts), b, dtype=np.int64))
            pos.append(starts.astype(np.int32))
            times.append(np.full(len(starts), n, dtype=np.int32))
        if hashes:
            h, n = _ask(np.concatenate(hashes), np.concatenate(times))
            yield from _emit([h, n, np.concatenate(k1), np.concatenate(k2), np.concatenate(pos)], ["h", "n", "k1", "k2", "pos"])


def repeated_anchors(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """k1, k2, ``at``: where the anchors of a text are that occur more than once in the corpus."""
    rows = documents.select(F.col(text_col).alias("text")).mapInArrow(
        _anchor_rows, "h long, n byte, k1 long, k2 long, pos int"
    )
    seen = rows.withColumn("seen", F.sum("n").over(Window.partitionBy("h"))).where("seen > 1")
    return seen.groupBy("k1", "k2").agg(F.collect_set("pos").alias("at"))


def packed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 and the compressed text."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [_text_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([a for a, _ in keys], pa.int64()),
                    pa.array([b for _, b in keys], pa.int64()),
                    pa.array([compressor.compress(t) for t in texts], pa.binary()),
                ],
                ["doc_id", "k1", "k2", "packed"],
            )

    return rows.mapInArrow(pack, f"doc_id {kind}, k1 long, k2 long, packed binary")


def _passage_rows(batches):
    """Full hashes of the passages around repeated anchors."""
    memo, first, second = _WordHashes(), _Powers(_BASE), _Powers(_SECOND)
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        own: dict[tuple[int, int], list] = {}
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            own.setdefault(key, [i, 0])[1] += 1
        parts = [[] for _ in range(6)]
        for (a, b), (i, n) in own.items():
            words = reader.decompress(batch.column(2)[i].as_py()).split()
            at = np.asarray(batch.column(3)[i].as_py(), dtype=np.int64)
            # Passages that hold an anchor at p start between p - PERIOD + 1 and p.
            edge = np.zeros(len(words) + 2, dtype=np.int32)
            np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(edge, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[: len(words) - PASSAGE + 1] > 0)
            values = _word_values(words, memo)
            parts[0].append(_windows(values, PASSAGE, starts, first))
            parts[1].append((_windows(values, PASSAGE, starts, second) >> np.uint64(33)).astype(np.int32))
            for p, v, t in ((2, n, np.int32), (3, a, np.int64), (4, b, np.int64)):
                parts[p].append(np.full(len(starts), v, dtype=t))
            parts[5].append(starts.astype(np.int32))
        if own:
            h, h2, n, k1, k2, start = map(np.concatenate, parts)
            asked, n = _ask(h, n)
            yield from _emit([asked, h2, n, k1, k2, start], ["h", "h2", "n", "k1", "k2", "start"])


def repeated_passages(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """k1, k2, ``starts``: where the passages of a text start that occur more than once."""
    rows = (
        texts.select("k1", "k2", "packed").join(anchors, ["k1", "k2"])
        .mapInArrow(_passage_rows, "h long, h2 int, n byte, k1 long, k2 long, start int")
    )
    seen = rows.withColumn("seen", F.sum("n").over(Window.partitionBy("h", "h2"))).where("seen > 1")
    return seen.groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))


def kept_words(words: list[bytes], starts) -> list[bytes]:
    if starts is None or not len(starts):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.asarray(starts, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + PASSAGE, -1)
    keep = np.cumsum(edge)[: len(words)] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the ``kept`` text (its words joined by one space) of every row."""
    texts = packed(documents, id_col, text_col)
    anchors = storage.staged(repeated_anchors(documents, text_col), "repeated-anchors")
    passages = storage.staged(repeated_passages(texts, anchors), "repeated-passages")
    joined = texts.join(passages, ["k1", "k2"], "left").select("doc_id", "packed", "starts")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            total, removed, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = reader.decompress(text.as_py()).split()
                left = kept_words(words, starts.values.to_numpy() if starts.is_valid else None)
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def report(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

