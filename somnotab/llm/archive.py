"""A content-addressed WARC archive.

Payload bytes are stored once, compressed, under their SHA-256; the exact header block of every record
is stored apart, with the digest of its payload. Original records are rebuilt by a join of the
two, and every payload read back is checked against the digest it is stored under.

Of records with equal payloads of at least ``SHARED_BYTES`` the one with the largest page id is the
response, the others are revisits that name it; smaller payloads are all responses.
Pages are scanned twice: once for digests, lengths and headers, which decide records on narrow rows, and
once for the bytes, which are compressed and stored under their digest. Copies have the same bytes, so any one may
be kept: each task keeps one of its own before anything is moved, and copies of one payload, however many, never
meet as such.

Defined cases: a null page is an empty payload; a null url is an empty target; of rows that repeat
page id and payload all are records and the bytes are stored once; a null page id is smaller than
any other; an empty table makes an empty archive.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.llm import storage

SHARED_BYTES = 1000
EPOCH = "1970-01-01T00:00:00Z"
#: Of the compression: payloads are moved and stored several times for each time that they are compressed.
LEVEL = 9
def _payload(html_col: str):
    return F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")


def digested(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, and of the payload: length, SHA-1, SHA-256."""
    payload = _payload(html_col)
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("sha1"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
    )


def payloads(pages: DataFrame, html_col: str) -> DataFrame:
    """digest, packed: the bytes of every payload once, compressed in the task that reads them."""
    rows = pages.select(_payload(html_col).alias("payload"))

    def compute(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = {}
            for payload in batch.column(0):
                data = payload.as_buffer()
                digest = hashlib.sha256(data).digest()
                if digest not in found:
                    found[digest] = compressor.compress(data)
            columns = [pa.array(list(x), pa.binary()) for x in (found.keys(), found.values())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "packed"])

    packed = rows.mapInArrow(compute, "digest binary, packed binary")
    return packed.groupBy("digest").agg(F.first("packed").alias("packed"))


def _header(kind, refers_url):
    """The header block, as it stands before the payload. A revisit has no payload of its own."""
    line = "\r\n"
    common = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), kind, F.lit(f"{line}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{line}WARC-Date: {EPOCH}{line}WARC-Target-URI: "),
        F.regexp_replace("url", "[\\r\\n]", " "), F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(line),
    )
    length = F.when(kind == "response", F.col("payload_bytes")).otherwise(0).cast("string")
    refers = F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_url.cast("string"), F.lit(f">{line}")))
    return F.concat(common, F.coalesce(refers, F.lit("")), F.lit("Content-Length: "), length, F.lit(line + line))


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    shared_bytes: int = SHARED_BYTES,
) -> None:
    """Write ``path``/payloads (digest, packed) and ``path``/records (headers)."""
    incoming = storage.staged(digested(pages, id_col, url_col, html_col), "incoming")
    several = incoming.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"), F.max("payload_bytes").alias("size"))
    # Stored, so that the join with a payload of very many records has two shuffled sides and can be split.
    several = several.where((F.col("n") > 1) & (F.col("size") >= shared_bytes))
    several = storage.staged(several.select("digest", "keeper", F.lit(True).alias("several")), "digests")
    revisit = F.col("several").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    records = incoming.join(several, "digest", "left").select(
        "page_id",
        "digest",
        kind.alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
        _header(kind, F.col("keeper")).alias("header"),
    )
    records.write.parquet(f"{path}/records")
    payloads(pages, html_col).write.parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records as written: page_id, record_type, refers_to, header, payload, digest, verified.

    Revisits come with the payload of the record they refer to, whose bytes they stand for.
    """
    joined = spark.read.parquet(f"{path}/records").join(spark.read.parquet(f"{path}/payloads"), "digest")
    kind = joined.schema["page_id"].dataType.simpleString()
    rows = joined.select("page_id", "record_type", "refers_to", "header", "digest", "packed")

    def unpack(batches):
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            payloads = [reader.decompress(p.as_buffer()) for p in batch.column(5)]
            for digest, payload in zip(batch.column(4).to_pylist(), payloads, strict=True):
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"payload does not match its digest {digest.hex()}")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(payloads, pa.binary())],
                ["page_id", "record_type", "refers_to", "header", "digest", "payload"],
            )

    return rows.mapInArrow(
        unpack, f"page_id {kind}, record_type string, refers_to {kind}, header string, digest binary, payload binary"
    )


def _record():
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n"))


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the record as it stands in a WARC file: header block, payload, two line ends."""
    return records.select("page_id", _record().alias("record"))


def report(records: DataFrame) -> DataFrame:
    """What the archive says of every page, taken from header, payload and whole record as read back."""
    header = F.col("header")
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.regexp_extract(header, "\\r\\nWARC-Type: ([a-z]+)", 1).alias("record_type"),
        "refers_to",
        F.sha2(_record(), 256).alias("record_sha256"),
        F.regexp_extract(header, "\\r\\nWARC-Payload-Digest: sha1:([0-9a-f]{40})", 1).alias("header_digest"),
    )
