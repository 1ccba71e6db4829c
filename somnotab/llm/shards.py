"""Shards by fixed virtual slots.

A record belongs for ever to the virtual slot its id and text hash to; a small map says which shard
holds a slot. Rebalancing edits the map, never the hash: a new version moves as few slots as it
takes to bring the bytes of the shards together. All versions are kept in one table, which later runs read,
edit and add to; two versions say which slots have to move.

The law is ``bytes``: the shards' sizes are near equal. ``slot`` is the row's place in its shard,
gapless from 0, in the order of virtual slots; within a virtual slot rows are ordered by id (null
first), size and checksum, so that only rows alike in all of these are interchangeable.

Defined cases: a null text counts as empty (size 1, checksum 0); a null id is hashed like a value;
repeated rows each have a place; an empty table gives an even map and no rows. Copies of a text
have different ids and spread over all virtual slots, so no group of them meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somnotab.llm import storage
from somnotab.sources.files import path_exists

VIRTUAL_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


def measured(documents: DataFrame, id_col: str, text_col: str, virtual_slots: int) -> DataFrame:
    """Id, size, checksum and virtual slot of every row: all that the rest works on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(virtual_slots)).cast("int").alias("virtual_slot"),
    )


def first_map(shards: int, virtual_slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Version 0, before any load is known: slots in turn."""
    return [slot % shards for slot in range(virtual_slots)]


def rebalanced(current: list[int], loads: list[int], shards: int) -> list[int]:
    """An edited map: slots move from the fullest to the emptiest shard while that narrows the gap.

    Among the slots of the fullest shard the one nearest to half the gap moves, so few do. A shard
    that can give none, as one huge document may be all it has, is passed over for the next fullest.
    Works on the map alone, whose length is a parameter.
    """
    edited = list(current)
    total = [0] * shards
    held = [set() for _ in range(shards)]
    for slot, shard in enumerate(edited):
        total[shard] += loads[slot]
        if loads[slot]:
            held[shard].add(slot)
    settled: set[int] = set()
    for _ in range(4 * len(edited)):
        full = max(set(range(shards)) - settled, key=lambda s: (total[s], -s), default=None)
        if full is None:
            break
        empty = min(range(shards), key=lambda s: (total[s], s))
        gap = total[full] - total[empty]
        fitting = [s for s in held[full] if loads[s] < gap]
        if not fitting:
            settled.add(full)
            continue
        slot = min(fitting, key=lambda s: (abs(2 * loads[s] - gap), s))
        edited[slot] = empty
        held[full].remove(slot)
        held[empty].add(slot)
        total[full] -= loads[slot]
        total[empty] += loads[slot]
        settled.discard(empty)
    return edited


def slot_loads(rows: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Bytes of each virtual slot; the driver sees one number per slot, never a row."""
    summed = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()
    loads = [0] * virtual_slots
    for row in summed:
        loads[row["virtual_slot"]] = row["bytes"]
    return loads


def write_version(spark: SparkSession, path: str, version: int, shard_of: list[int], loads: list[int]) -> None:
    rows = [(version, slot, shard, loads[slot]) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last version of a stored map; None if there is no map."""
    if not path_exists(spark, path):
        return None
    return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]


def _fitted(current: list[int], shards: int) -> list[int]:
    """The map for a number of shards: slots of shards that are gone are dealt to the others in turn."""
    return [shard if shard < shards else slot % shards for slot, shard in enumerate(current)]


def stored_map(
    rows: DataFrame, shards: int, virtual_slots: int = VIRTUAL_SLOTS, path: str | None = None
) -> DataFrame:
    """virtual_slot, shard: the newest version of a map that is stored with all its versions.

    The map at ``path`` is edited for the loads of ``rows`` and kept there as its next version; if nothing
    moves, it stays as it is. Without a path, or with one that holds no map yet, an even map is version 0.
    """
    spark = rows.sparkSession
    loads = slot_loads(rows, virtual_slots)
    path = storage.new_path(spark, "slot-map") if path is None else path
    version = newest_version(spark, path)
    if version is None:
        version = 0
        current = first_map(shards, virtual_slots)
        write_version(spark, path, version, current, loads)
    else:
        stored = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, version).collect()}
        if len(stored) != virtual_slots:
            raise ValueError(f"the stored map has {len(stored)} virtual slots, not {virtual_slots}")
        current = [stored[slot] for slot in range(virtual_slots)]
    edited = rebalanced(_fitted(current, shards), loads, shards)
    if edited != current:
        version += 1
        write_version(spark, path, version, edited, loads)
    return read_map(spark, path, version).select("virtual_slot", "shard")


def moved(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """virtual_slot, old_shard, new_shard, bytes: what has to be carried from one version to the other."""
    old = read_map(spark, path, before).select("virtual_slot", F.col("shard").alias("old_shard"))
    new = read_map(spark, path, after).select("virtual_slot", F.col("shard").alias("new_shard"), "bytes")
    return old.join(new, "virtual_slot").where("old_shard <> new_shard").select("virtual_slot", "old_shard", "new_shard", "bytes")


def assign(
    documents: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_slots: int = VIRTUAL_SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """Size, checksum, shard and place of every row; ``map_path`` keeps the map from run to run."""
    rows = storage.staged(measured(documents, id_col, text_col, virtual_slots), "sharding")
    # Where a virtual slot begins within its shard: a running count over the map's few rows.
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    begins = stored_map(rows, shards, virtual_slots, map_path).join(counts, "virtual_slot").select("virtual_slot", "shard", begin)
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("place", F.row_number().over(within) - 1)
    return placed.join(storage.small_side(begins, virtual_slots, 32), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("begin") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def placed(
    documents: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_slots: int = VIRTUAL_SLOTS,
    map_path: str | None = None,
) -> DataFrame:
    """The rows themselves with their ``shard``: a look-up in the map, so no text is moved."""
    (slot,) = storage.fresh(documents, "slot")
    rows = measured(documents, id_col, text_col, virtual_slots).select("virtual_slot", "size")
    newest = stored_map(rows, shards, virtual_slots, map_path).select(F.col("virtual_slot").alias(slot), F.col("shard").alias("shard"))
    own = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(virtual_slots)).cast("int")
    kept = [c for c in documents.columns if c.lower() != "shard"]
    rows = documents.select(*kept, own.alias(slot))
    return rows.join(storage.small_side(newest, virtual_slots, 32), slot).select(*kept, "shard")
