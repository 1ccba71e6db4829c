"""Keyword search over file contents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somnotab.sources.opened import system_of

# The five outcomes.
TEXT_WITH = "texto_con_palabra"
TEXT_WITHOUT = "texto_sin_palabra"
BINARY_WITH = "binarios_con_palabra"
BINARY_WITHOUT = "binarios_sin_palabra"
NOT_PROCESSED = "no_procesados"

# Fixed value: how many leading bytes decide between text and binary.
PROBE_BYTES = 1024


def is_text(content: Column) -> Column:
    """No NUL byte among the leading ones."""
    head = F.substring(content, 1, PROBE_BYTES)
    return ~F.contains(head, F.lit(bytes(1)))


def bucket(content: Column, word: str) -> Column:
    """Outcome of one file: literal, case-sensitive search for the word.

    Text must be valid UTF-8 to match; text that is not, counts as without the word.
    Content that could not be read is not processed.
    """
    present = F.contains(content, F.lit(word.encode("utf-8")))
    decodable = F.is_valid_utf8(content.cast("string"))
    return (
        F.when(content.isNull(), NOT_PROCESSED)
        .when(is_text(content) & present & decodable, TEXT_WITH)
        .when(is_text(content), TEXT_WITHOUT)
        .when(present, BINARY_WITH)
        .otherwise(BINARY_WITHOUT)
    )


def search(files: DataFrame, word: str) -> DataFrame:
    """``files(path, content)`` to ``(path, bucket)``; no shuffle, content is not kept."""
    return files.select("path", bucket(F.col("content"), word).alias("bucket"))


def _cut_short(data: bytes, own: int) -> int | None:
    """Bytes behind the first ``own`` ones that complete their last character; None if they are not UTF-8."""
    for more in range(4):
        try:
            data[: own + more].decode("utf-8")
            return more
        except UnicodeDecodeError as error:
            if error.start < own - 3:
                return None
    return None


def _chunk_facts(data: bytes, own: int, first: bool, word: bytes) -> tuple[bool, bool, bool, int, int]:
    """Of a chunk of ``own`` bytes and what was read behind it: whether the word begins in it, NUL among the
    first bytes, whether it is UTF-8 but for its ends, and the bytes that belong to a character of the chunk
    before, and that its own last character takes from the next."""
    present = word in data[: own + len(word) - 1]
    binary = first and b"\0" in data[: min(own, PROBE_BYTES)]
    head = 0
    while head < min(3, own) and data[head] & 0xC0 == 0x80:
        head += 1
    tail = _cut_short(data[head : own + 3], own - head)
    return present, binary, tail is not None, head, tail or 0


def _reader(word: bytes):
    def read(batches):
        for batch in batches:
            rows = []
            for path, begin, own in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                try:
                    system, name = system_of(path)
                    with system.open_input_file(name) as file:
                        data = file.read_at(own + max(3, len(word) - 1), begin)
                    rows.append((path, begin, True, *_chunk_facts(data, min(own, len(data)), begin == 0, word)))
                except OSError:
                    rows.append((path, begin, False, False, False, False, 0, 0))
            kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 4, pa.int32(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, _FACTS)

    return read


_FACTS = ["path", "begin", "read", "present", "binary", "valid", "head", "tail"]


def search_files(files: DataFrame, word: str, chunk_bytes: int = 32 << 20) -> DataFrame:
    """``files(path, length)`` to ``(path, bucket)``, for files of any size: no task holds more than a chunk.

    Chunks are read with an overlap as long as the word less one, and each says how many of its first bytes
    end a character of the chunk before and how many its last character takes from the next one: a file is
    valid UTF-8 if its chunks are and these agree. Files that cannot be opened are not processed.
    """
    if chunk_bytes < max(PROBE_BYTES, 4):
        raise ValueError("a chunk holds the bytes that tell text from binary")
    last = F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(0)).cast("long")
    chunks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")).select(
        "path", (F.col("chunk") * chunk_bytes).alias("begin"), F.lit(chunk_bytes).cast("long").alias("own")
    )
    # Each chunk is a piece of work of its own, wherever its file was listed.
    facts = chunks.repartition("path", "begin").mapInArrow(
        _reader(word.encode("utf-8")),
        "path string, begin long, read boolean, present boolean, binary boolean, valid boolean, head int, tail int",
    )
    before = F.lag("tail", 1, 0).over(Window.partitionBy("path").orderBy("begin"))
    after = F.lead("begin").over(Window.partitionBy("path").orderBy("begin"))
    fits = F.col("valid") & (F.col("head") == before) & (after.isNotNull() | (F.col("tail") == 0))
    folded = facts.withColumn("fits", fits).groupBy("path").agg(
        F.every("read").alias("read"),
        F.some("present").alias("present"),
        F.some("binary").alias("binary"),
        F.every("fits").alias("valid"),
    )
    outcome = (
        F.when(~F.col("read"), NOT_PROCESSED)
        .when(~F.col("binary") & F.col("present") & F.col("valid"), TEXT_WITH)
        .when(~F.col("binary"), TEXT_WITHOUT)
        .when(F.col("present"), BINARY_WITH)
        .otherwise(BINARY_WITHOUT)
    )
    return folded.select("path", outcome.alias("bucket"))


def counts(found: DataFrame) -> DataFrame:
    """``(bucket, n)`` for all five buckets, also the empty ones."""
    buckets = (TEXT_WITH, TEXT_WITHOUT, BINARY_WITH, BINARY_WITHOUT, NOT_PROCESSED)
    tallies = [F.count_if(F.col("bucket") == b).alias(b) for b in buckets]
    lines = [F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in buckets]
    return found.agg(*tallies).select(F.inline(F.array(*lines)))


def listing(found: DataFrame) -> DataFrame:
    """The files of each bucket as rows in order, however many there are."""
    return found.select("bucket", "path").orderBy("bucket", "path")
