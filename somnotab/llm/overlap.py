"""Documents whose sets of word shingles have a Jaccard similarity of at least ``percent`` / 100, exactly.

Equal sets become one node first. Nodes meet in tiles, one for each band of sizes; the smaller set of a
linked pair names the band, so a set belongs to its own band's tile and to those below that its size can reach.
Two necessary conditions split a tile into buckets, both chosen so that no linked pair can miss each other:

* Sets of fewer than ``SMALL`` shingles: sorted by hash, linked sets share ``TOGETHER`` shingles within their
  first floor((1 - J) * size) + TOGETHER ones. Each choice of that many shingles from there is a bucket.
* Larger sets: shingles are hashed into D + 1 + e classes, where D bounds the symmetric difference of the pairs
  of the tile, so at least e + 1 classes are equal as sets. A class of at least ``STRONG`` shingles is a bucket. Weak
  classes say little and would bring strangers together; they are left out unless a set has more than e of
  them. That is safe: equal classes are weak in both sets, so if all e + 1 are, neither set left its weak ones out.

Within a bucket pairs are bounded before they are compared. A signature holds the parity of the number
of shingles under each hashed bit; the bits in which two signatures differ are at most the symmetric
difference, which bounds the overlap from above. Only pairs that pass are compared by their sorted arrays.

Only components are wanted, so pairs whose ends are connected already are not compared:

1. every member of a bucket with the bucket's smallest node;
2. members outside the bucket's largest component with the likeliest member of every other component;
3. all pairs of different components that pass the bound.

Steps 2 and 3 cut a bucket of any size into tiles of at most ``BLOCK`` by ``BLOCK`` nodes. Nothing is capped:
what step 1 and 2 do not connect, step 3 compares in full.

Defined cases: a text without words, or null, is linked with nothing; a text of fewer words than a shingle has
its whole sequence as its one shingle; repeated rows and copies are one node; a null id never names a
component unless its component has no other; an empty table gives no rows; other columns are not read.
Shingles are told apart by 64 bits and sets by 128.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnotab.llm import simhash, storage

SHINGLE = 3
PERCENT = 90
SMALL = 50
TOGETHER = 3
STRONG = 3
BLOCK = 512
_LEAST_BITS = 256
_TILE_ROWS = 20_000
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.encode().lower().split() if text else []
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if not words:
        return hashed
    width = min(width, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        found = _mixed(found + hashed[k : k + n])
    return np.unique(found)


def most_apart(total: int, percent: int) -> int:
    """The largest symmetric difference of a linked pair whose sizes sum to ``total``."""
    return total * (100 - percent) // (100 + percent)


@cache
def tile(number: int, percent: int) -> tuple[int, int, int, int]:
    """Of a band: smallest size, largest size of a partner, classes, and how many classes are spare."""
    low = SMALL
    for _ in range(number):
        low = low * 5 // 4
    last = low * 5 // 4 - 1
    partner = last * 100 // percent
    needed = most_apart(last + partner, percent) + 1
    spare = -(-needed // 4)
    return low, partner, needed + spare, spare


def tiles_of(size: int, percent: int) -> list[int]:
    """The bands that a set of this size meets others in."""
    found, number = [], 0
    while (borders := tile(number, percent))[0] <= size:
        if size <= borders[1]:
            found.append(number)
        number += 1
    return found


def class_keys(found: np.ndarray, number: int, percent: int) -> np.ndarray:
    _, _, classes, spare = tile(number, percent)
    spread = _mixed(found)
    own = ((spread >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    present, begins, counts = np.unique(own[order], return_index=True, return_counts=True)
    sums = np.zeros(classes, dtype=np.uint64)
    sums[present] = np.add.reduceat(spread[order], begins)
    strong = np.zeros(classes, dtype=bool)
    strong[present] = counts >= STRONG
    emitted = np.flatnonzero(strong) if classes - strong.sum() <= spare else np.arange(classes)
    places = emitted.astype(np.uint64) + np.uint64((number + 1) << 40)
    return _mixed(sums[emitted] + _mixed(places))


@cache
def _choices(length: int) -> np.ndarray:
    return np.array(list(combinations(range(length), TOGETHER)), dtype=np.int64).reshape(-1, TOGETHER)


def prefix_keys(found: np.ndarray, percent: int) -> np.ndarray:
    size = len(found)
    if size * 100 // percent == size and -(-size * percent // 100) == size:
        return found[:0]  # only an equal set is near enough
    length = min(size, size * (100 - percent) // 100 + TOGETHER)
    return _mixed(_mixed(found[:length])[_choices(length)].sum(axis=1, dtype=np.uint64))


def keys(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The buckets of a set."""
    made = [class_keys(found, number, percent) for number in tiles_of(len(found), percent)]
    if len(found) <= (SMALL - 1) * 100 // percent:
        made.append(prefix_keys(found, percent))
    return np.unique(np.concatenate(made))


def signature(found: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parities of the shingles under each bit; eight bits for each that a partner may differ in."""
    apart = most_apart(len(found) + len(found) * 100 // percent, percent)
    bits = max(_LEAST_BITS, 1 << (8 * apart).bit_length())
    places = (found & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(places, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _folded(signatures: list[bytes], length: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, folded to the length of the shortest, which keeps parities."""
    rows = np.empty((len(signatures), length // 8), dtype=np.uint64)
    for i, one in enumerate(signatures):
        words = np.frombuffer(one, dtype=np.uint64)
        while len(words) * 8 > length:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        rows[i] = words
    return rows


def _within(sizes, others, apart, percent: int):
    """Whether an overlap that leaves ``apart`` shingles unshared is enough."""
    total = sizes + others
    return (total - apart) // 2 * (100 + percent) >= percent * total


def sets(documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, and of texts with words: digest, signature, buckets."""
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def described(text):
        found = shingles(text, width)
        if not len(found):
            return 0, None, None, found
        return len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found, percent), keys(found, percent)

    def compute(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = {t: described(t) for t in set(texts)}
            sizes, digests, signatures, buckets = zip(*[known[t] for t in texts], strict=True) if texts else ([],) * 4
            ends = np.cumsum([0, *map(len, buckets)])
            joined = np.concatenate(buckets) if texts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined.view(np.int64))),
                ],
                ["doc_id", "text_key", "n_shingles", "digest", "signature", "keys"],
            )

    return rows.mapInArrow(
        compute, f"doc_id {kind}, text_key long, n_shingles long, digest binary, signature binary, keys array<long>"
    )


def buckets(nodes: DataFrame) -> DataFrame:
    """key, n, center, node: every bucket of several nodes, with its size and its smallest node.

    Near sets share many buckets. Of those with the same members one is kept.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1")
    # Stored, so that the join with a key of very many nodes has two shuffled sides and can be split.
    shared = storage.staged(shared, "overlap-shared")
    several = storage.staged(keyed.join(shared, "key"), "overlap-buckets")
    members = several.groupBy("key", "n", "center").agg(
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    kept = members.groupBy("n", "center", "x", "y").agg(F.min("key").alias("key")).select("key")
    return storage.staged(several.join(kept, "key", "left_semi"), "overlap-distinct-buckets")


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures do not rule them out."""
    one = nodes.select(F.col("node").alias("u"), F.col("size").alias("a"), F.col("signature").alias("s"))
    other = nodes.select(F.col("node").alias("v"), F.col("size").alias("b"), F.col("signature").alias("t"))
    rows = pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b", "s", "t")

    def passing(batches):
        for batch in batches:
            a, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = np.zeros(len(a), dtype=np.int64)
            for i, (s, t) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x = _folded([s, t], min(len(s), len(t)))
                apart[i] = np.bitwise_count(x[0] ^ x[1]).sum()
            mask = pa.array(_within(a, b, apart, percent))
            yield batch.select([0, 1]).filter(mask)

    return rows.mapInArrow(passing, "u long, v long")


def _tile_candidates(tiles: pd.DataFrame, percent: int, every: bool):
    """Pairs of different components in each tile that pass the bound; else of each component the nearest."""
    for _, rows in tiles.groupby(["key", "block", "chunk"], sort=False):
        asked, members = rows[rows["asked"]], rows[~rows["asked"]]
        if asked.empty or members.empty:
            continue
        length = min(map(len, rows["signature"]))
        prints = _folded(members["signature"].tolist(), length)
        nodes, labels, sizes = (members[c].to_numpy() for c in ("node", "label", "size"))
        questions = _folded(asked["signature"].tolist(), length)
        for own, node, label, size in zip(questions, asked["node"], asked["label"], asked["size"], strict=True):
            apart = np.bitwise_count(prints ^ own).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero((labels != label) & _within(sizes, size, apart, percent))
            if not every:
                near = near[np.argsort(apart[near], kind="stable")]
                near = near[np.unique(labels[near], return_index=True)[1]]
            for k in near.tolist():
                yield max(node, nodes[k]), min(node, nodes[k])


def candidates(meeting: DataFrame, rooted: DataFrame, nodes: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (u, v) of one bucket and different components that the signatures do not rule out."""
    spark = nodes.sparkSession
    known = meeting.where("n > 2").join(rooted, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("label")
    )
    known = storage.staged(known, "overlap-labelled")
    parts = known.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = parts.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")
    chunks = F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("long").alias("chunks")
    split = split.where("parts > 1").select("key", F.col("main.label").alias("main"), blocks, chunks)
    split = storage.staged(split, "overlap-split")
    rows = known.join(split, "key")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = rows.select(
        "key", "node", "label", F.lit(False).alias("asked"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), upto("chunks").alias("chunk"),
    )
    asked = rows.where("label <> main").select(
        "key", "node", "label", F.lit(True).alias("asked"),
        upto("blocks").alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).alias("chunk"),
    )
    tiles = storage.staged(members.unionByName(asked), "overlap-tiles")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tiles.count() // _TILE_ROWS))
    dealt = tiles.join(nodes.select("node", "size", "signature"), "node").withColumn(
        "group", F.pmod(F.xxhash64("key", "block", "chunk"), F.lit(groups))
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_tile_candidates(frame, percent, every), columns=["u", "v"])

    return dealt.groupBy("group").applyInPandas(compare, "u long, v long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The linked pairs among (u, v), by the sorted arrays of their shingles.

    Only texts that take part are read out again. All pairs of one v meet it in groups of at most about
    ``BLOCK``, so its array travels once for each of these.
    """
    # A row is found again by its id and a hash of its text.
    taking = pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()
    taking = taking.join(nodes.select("node", "first.doc_id", "first.text_key"), "node")
    rows = documents.select(
        F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_key"), F.col(text_col).alias("text")
    ).join(taking, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")))
    texts = rows.select("node", "text").dropDuplicates(["node"])

    def compute(batches):
        for batch in batches:
            arrays = [shingles(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.binary())], ["node", "shingles"])

    arrays = storage.staged(texts.mapInArrow(compute, "node long, shingles binary"), "overlap-arrays")
    often = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("chunks"))
    often = storage.staged(often, "overlap-often")
    chunk = F.pmod(F.xxhash64("u"), F.col("chunks")).alias("chunk")
    own = arrays.select(F.col("node").alias("u"), F.col("shingles").alias("array"))
    ones = pairs.join(often, "v").select("v", "u", chunk).join(own, "u")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    others = often.select(F.col("v").alias("node"), chunk).join(arrays, "node")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = np.frombuffer(right["shingles"].iloc[0], dtype=np.uint64)
        linked = []
        for one in left["array"]:
            a = np.frombuffer(one, dtype=np.uint64)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = int((b[at] == a).sum())
            linked.append(100 * common >= percent * (len(a) + len(b) - common))
        return left.loc[linked, ["u", "v"]]

    return ones.groupBy("v", "chunk").cogroup(others.groupBy("node", "chunk")).applyInPandas(compare, "u long, v long")


def groups(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable) of every row."""
    if not 80 <= percent <= 99:
        raise ValueError("the bands are made for similarities of 80 to 99 percent")
    rows = storage.staged(sets(documents, id_col, text_col, width, percent), "overlap-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    distinct = rows.where("digest is not null").groupBy("digest").agg(
        first, F.first("n_shingles").alias("size"), F.first("signature").alias("signature"), F.first("keys").alias("keys")
    )
    nodes = storage.staged(distinct.withColumn("node", F.monotonically_increasing_id()), "overlap-nodes")
    meeting = buckets(nodes)

    def linked(pairs):
        pairs = storage.staged(pairs, "overlap-pairs")
        return storage.staged(verified(pairs, nodes, documents, id_col, text_col, width, percent), "overlap-links")

    star = meeting.where("node <> center").select(F.col("node").alias("u"), F.col("center").alias("v")).distinct()
    edges = linked(bounded(star, nodes, percent))
    rooted = storage.staged(simhash.components(edges), "overlap-components")
    for every in (False, True):
        pairs = storage.staged(candidates(meeting, rooted, nodes, percent, every), "overlap-candidates")
        if pairs.isEmpty():
            break
        edges = edges.unionAll(linked(pairs))
        rooted = storage.staged(simhash.components(edges), "overlap-components")

    labelled = nodes.select("node", "digest", F.col("first.doc_id").alias("least")).join(rooted, "node", "left")
    labelled = labelled.select("digest", "least", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = storage.staged(labelled.join(smallest, "root").select("digest", "component_id"), "overlap-named")
    found = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))
