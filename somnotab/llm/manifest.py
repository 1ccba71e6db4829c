"""A Merkle manifest of a dataset: one root, and for every row a proof that leads from it to that root.

A row's fields, each with its length, make a leaf. The leaves of a source, ordered by id, form a tree of
arity 3; the subroots of all sources, ordered by name, form another one above them.

Subtrees are exchanged whole. ``DEPTH`` levels above its 3 ** DEPTH nodes stands a superblock; it is the
unit of every shuffle, so a source of any size is spread over many tasks and no group exceeds 2,187
rows. Going up, each superblock is reduced to its one node, which takes its place in the next, smaller layer, until
a source has a single node left. Coming down, the nodes of a superblock are cogrouped with the one
row of outer nodes that all of them need: the siblings on the way from the superblock's node to the root. One
function then reduces the superblock again, joins local and outer siblings into each row's proof and folds
what the row claims along it.

Places within a source come from a range sort: a row's place in its partition, plus the rows of its source in
earlier partitions. No window or group ever holds a source.

Defined cases: null fields are written ``-``; a null source is a source, the first one; a null id comes first in
its source and is never tampered with; rows that repeat an id are ordered by leaf, and rows alike in both
are interchangeable; an empty table has no rows and no root; columns other than the five are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somnotab.llm import storage

ARITY = 3
DEPTH = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows of fields are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def tampered(text: Column) -> Column:
    """The change that the proofs must notice: line feeds vanish."""
    return F.translate(text, "\n", "")


def leaves(documents: DataFrame, tamper: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, source key, leaf, and the leaf of what the row claims to be. The last field is the text.

    ``tamper`` says which rows are changed before they are claimed; by default none. The key of a source
    is never null and keeps the order of names: empty for null, else ``=`` and the name.
    """
    columns = [F.col(f) for f in fields]
    made = leaf(columns)
    claimed = made
    if tamper is not None:
        changed = F.coalesce(tamper, F.lit(False)) & F.coalesce(columns[-1].contains("\n"), F.lit(False))
        claimed = F.when(changed, leaf([*columns[:-1], tampered(columns[-1])])).otherwise(made)
    key = F.coalesce(F.concat(F.lit("="), F.col(fields[1]).cast("string")), F.lit(""))
    return documents.select(
        columns[0].alias("doc_id"), key.alias("tree"), made.alias("digest"), claimed.alias("claimed")
    )


def even_checksum(identifier: Column) -> Column:
    return F.crc32(F.encode(identifier.cast("string"), "UTF-8")) % 2 == 0


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their place ``pos`` in their tree and its number of nodes ``n``.

    Sorted by tree and ``order`` over all tasks. Rows alike in all of these are dealt out by a salt, so
    that a third of the table may be one and the same row.
    """
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ordered = salted.orderBy("tree", *order, "salt").drop("salt")
    ordered = storage.staged(ordered.withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = storage.staged(
        runs.select(
            "tree", "part", "first",
            F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"),
            F.sum("size").over(Window.partitionBy("tree")).alias("n"),
        ),
        "manifest-runs",
    )
    widest = runs.agg(F.max(F.octet_length("tree"))).first()[0] or 0
    side = storage.small_side(runs, runs.count(), 64 + widest)
    return ordered.join(side, ["tree", "part"]).select(
        *rows.columns, (F.col("begin") + F.col("at") - F.col("first")).alias("pos"), "n"
    )


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(n: int) -> int:
    """By how many levels the superblocks of a tree with n nodes in this layer are reduced."""
    levels = 0
    while n > 1 and levels < DEPTH:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _reduced(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level; the last level holds its one node."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([_hash("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return found


def _sides(level: list[str]) -> list[tuple[str, str]]:
    """What stands left and right of every node in its run."""
    sides = []
    for i in range(len(level)):
        begin = i - i % ARITY
        sides.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + ARITY])))
    return sides


def _block() -> Column:
    return F.floor(F.col("pos") / F.lit(ARITY**DEPTH)).cast("long")


def next_layer(nodes: DataFrame) -> DataFrame:
    """tree, pos, n, digest: every superblock of the layer as one node."""

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        digests = block.sort_values("pos")["digest"].tolist()
        levels = _levels(int(first["n"]))
        n = int(first["n"])
        for _ in range(levels):
            n = -(-n // ARITY)
        top = _reduced(digests, levels)[-1][0]
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["block"])], "n": [n], "digest": [top]})

    rows = nodes.select("tree", "pos", "n", "digest", _block().alias("block"))
    return rows.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, digest string")


def layers(nodes: DataFrame) -> list[DataFrame]:
    """The layers of all trees, from the given one to that in which every tree has one node."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        found.append(storage.staged(next_layer(found[-1]), "manifest-layer"))
    return found


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame):
    """Per node of a superblock, in order of place: its steps to the root as (left, right) pairs."""
    levels = _levels(int(nodes["n"].iloc[0]))
    sides = [_sides(level) for level in _reduced(nodes["digest"].tolist(), levels)[:-1]]
    above = [(s["left"], s["right"]) for s in outer["steps"].iloc[0]]
    for i in range(len(nodes)):
        steps = []
        for level in sides:
            steps.append(level[i])
            i //= ARITY
        yield steps + above


def paths(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """tree, pos, steps, root: the siblings of every node from its level to the root."""

    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        steps = [[{"left": a, "right": b} for a, b in path] for path in _joined(block, above)]
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "steps": steps, "root": above["root"].iloc[0]})

    inner = nodes.select("tree", "pos", "n", "digest", _block().alias("block")).groupBy("tree", "block")
    return inner.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(
        join, f"tree string, pos long, steps {STEPS}, root string"
    )


def descend(found: list[DataFrame], top: DataFrame) -> DataFrame:
    """From the steps of the single nodes on top of all trees down to those of the second layer's nodes."""
    for layer in reversed(found[1:-1]):
        top = storage.staged(paths(layer, top), "manifest-paths")
    return top


def verified(rows: DataFrame, outer: DataFrame, subroots: DataFrame) -> DataFrame:
    """Each leaf with its proof and what its claim folds to; leaves and outer nodes meet by superblock."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        proofs, folded = [], []
        for claim, path in zip(block["claimed"].tolist(), _joined(block, above), strict=True):
            proofs.append(_hash("".join([left + right for left, right in path])))
            for left, right in path:
                claim = _hash(left + claim + right)
            folded.append(claim)
        out = block[["doc_id", "digest"]].copy()
        out["subroot"], out["root"] = above["subroot"].iloc[0], above["root"].iloc[0]
        out["proof_sha256"], out["folded_root"] = proofs, folded
        return out

    known = outer.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    inner = rows.withColumn("block", _block()).groupBy("tree", "block")
    done = inner.cogroup(known.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(
        finish, f"doc_id {kind}, digest string, subroot string, root string, proof_sha256 string, folded_root string"
    )
    return done.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def manifest(documents: DataFrame, tamper: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    made = storage.staged(leaves(documents, tamper, fields), "manifest-leaves")
    rows = storage.staged(placed(made, "doc_id", "digest"), "manifest-placed")
    sources = layers(rows)
    subroots = sources[-1].select("tree", "digest")
    # The upper tree: one node for each source, in the order of their names.
    owners = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("owner"), "digest")
    owners = storage.staged(placed(owners, "owner"), "manifest-sources")
    upper = layers(owners)
    no_steps = F.array().cast(STEPS)
    summit = upper[-1].select("tree", "pos", no_steps.alias("steps"), F.col("digest").alias("root"))
    if len(upper) > 1:
        summit = storage.staged(paths(owners, descend(upper, summit)), "manifest-paths")
    named = owners.select("pos", "owner").join(summit.drop("tree"), "pos")
    top = storage.staged(named.select(F.col("owner").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", "root"), "manifest-top")
    return verified(rows, descend(sources, top), subroots)
