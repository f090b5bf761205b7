"""Sharding by fixed virtual slots, with a versioned slot-to-shard map.

Each record is hashed by its text into one of ``slots`` virtual slots, so equal
texts share a slot; bytes and rows are summed for each slot.  The map from slot
to shard is a table of bounded size, stored in numbered versions that are never
overwritten: the first deals slots out in turn; each later one is the latest one
edited, by moving slots from the fullest to the emptiest shard until sizes are
near equal.  A run over a stored map starts from its latest version and writes a
new one only if it moves something, so that records never move except by an edit
of the map; to grow, ask for more shards over the same map.

Only a text whose copies alone exceed a shard is spread: they leave their slot's
main cell (sub 0) for ``SUBS`` sub-cells, by a hash of the identifier.  All other
texts stay whole.

The path over the data is made of DataFrame functions only.  Only the totals of
slots and of those few sub-cells, at most ``slots + shards * SUBS`` rows whatever
the input, meet in the driver.

Within a shard rows are numbered without gaps, and without a shuffle of rows:
each partition of the stored records is ordered by shard, its rows numbered, and
counts for each partition and shard say how many come before.

Cases: a null text has no bytes and the hash of an empty one; null and repeated
identifiers are rows like any other.  An empty table gives an empty result and a
map without cells.  Extra columns do not matter.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelattice.llm.runtime import BROADCAST_ROWS, Scratch, crc, table

SLOTS = 4096
#: Sub-cells over which a text is spread that exceeds a shard.
SUBS = 64

MAP_SCHEMA = "vslot int, sub int, shard int"
Cell = tuple[int, int]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, the virtual slot and a 64-bit mark of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc("text").alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"),
        F.xxhash64(text, F.lit(7)).alias("mark"),
    )


def hot_texts(rows: DataFrame, slot_bytes: dict[int, int], shards: int) -> list[tuple[int, int]]:
    """(vslot, mark) of the texts whose copies alone exceed a shard: fewer than ``shards``."""
    mean = sum(slot_bytes.values()) / shards
    heavy = [slot for slot, size in slot_bytes.items() if size > mean]  # fewer than shards
    if not heavy:
        return []
    found = rows.where(F.col("vslot").isin(heavy)).groupBy("vslot", "mark").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > mean)
    return [(r.vslot, r.mark) for r in found.collect()]


def rebalance(now: dict[Cell, int], sizes: dict[Cell, int], shards: int, near: float = 0.002) -> dict[Cell, int]:
    """The map after moving slots from the fullest to the emptiest shard.

    Each move takes the slot whose size is closest to half the difference, so
    the difference shrinks with every move; it ends when shards differ by at
    most ``near`` of the mean or no move helps.
    """
    now = dict(now)
    load, held = [0] * shards, [[] for _ in range(shards)]
    for cell, shard in now.items():
        load[shard] += sizes[cell]
        held[shard].append((sizes[cell], cell))
    for cells in held:
        cells.sort()
    mean = sum(load) / shards
    for _ in range(8 * len(now)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap, cells = load[full] - load[empty], held[full]
        if gap <= near * mean:
            break
        at = bisect_left(cells, (gap / 2,))
        fits = [(abs(cells[i][0] - gap / 2), i) for i in (at - 1, at) if 0 <= i < len(cells) and 0 < cells[i][0] < gap]
        if not fits:
            break
        size, cell = cells.pop(min(fits)[1])
        insort(held[empty], (size, cell))
        now[cell] = empty
        load[full] -= size
        load[empty] += size
    return now


def edited_map(stored: dict[Cell, int], sizes: dict[Cell, int], shards: int) -> dict[Cell, int]:
    """The stored map for the cells of ``sizes`` and those it had before: new cells are dealt out in turn, then slots are moved."""
    sizes = {c: 0 for c in stored} | sizes
    dealt = {c: stored[c] if stored.get(c, shards) < shards else (c[0] + c[1]) % shards for c in sizes}
    return rebalance(dealt, sizes, shards)


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table, by one JSON literal."""
    kinds = [part.split() for part in schema.split(", ")]
    text = json.dumps([dict(zip((n for n, _ in kinds), row)) for row in rows])
    kind = ", ".join(f"{n}: {t}" for n, t in kinds)
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>")).alias("x")).select("x.*")


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the latest stored version, -1 if there is none."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    found = [f.getPath().getName() for f in files.listStatus(folder)]
    return max((int(n.split("=")[1]) for n in found if n.startswith("version=")), default=-1)


def save_map(spark: SparkSession, path: str, version: int, shard_of: dict[Cell, int]) -> None:
    """Store a version of the map; one that exists is never overwritten."""
    rows = _literal(spark, [(*cell, shard) for cell, shard in sorted(shard_of.items())], MAP_SCHEMA)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with ``slot``, their number within their shard; rows stay in their partitions."""
    at = F.monotonically_increasing_id()  # the partition's number and, below it, the row's
    rows = scratch.keep(rows.sortWithinPartitions("shard").withColumn("_at", at), "placed").withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part", "shard").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    counts = scratch.keep(counts.withColumn("_ahead", ahead).drop("_n"), "counts")  # a row for each partition and shard
    few = counts.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(counts) if few else counts, ["_part", "shard"])
    return rows.withColumn("slot", F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_at", "_part", "_first", "_ahead")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (position in the shard), vslot, sub, map_version.

    ``map_path`` holds the versions of the map; without it they are stored for this run alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.keep(records(docs, slots).withColumn("_row", F.monotonically_increasing_id()), "records")
    sizes: dict[Cell, int] = {(r.vslot, 0): r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}  # at most slots rows
    hot = hot_texts(rows, {slot: size for (slot, _), size in sizes.items()}, shards)
    spread = F.lit(False)
    for slot, mark in hot:
        spread = spread | (F.col("vslot") == slot) & (F.col("mark") == F.lit(mark))
    by = F.xxhash64(F.coalesce(F.col("doc_id"), F.col("_row")), F.lit(1))
    rows = rows.withColumn("sub", F.when(spread, F.pmod(by, F.lit(SUBS)) + 1).otherwise(0).cast("int"))
    if hot:
        split = rows.where(F.col("vslot").isin([slot for slot, _ in hot])).groupBy("vslot", "sub").agg(F.sum("size").alias("bytes")).collect()  # at most shards * (SUBS + 1) rows
        sizes = {c: n for c, n in sizes.items() if c[0] not in {slot for slot, _ in hot}} | {(r.vslot, r.sub): r.bytes for r in split}
    path = map_path or scratch.path("map")
    version = latest_version(spark, path)
    stored = {(r.vslot, r.sub): r.shard for r in load_map(spark, path, version).collect()} if version >= 0 else {}
    if version < 0:
        stored, version = {c: (c[0] + c[1]) % shards for c in sizes}, 0
        save_map(spark, path, 0, stored)
    placed = edited_map(stored, sizes, shards)
    if placed != stored:
        version += 1
        save_map(spark, path, version, placed)
    rows = rows.join(F.broadcast(load_map(spark, path, version)), ["vslot", "sub"])  # at most slots + shards * SUBS rows, and those of earlier versions
    out = numbered(rows.select("doc_id", "size", "text_crc32", "shard", "vslot", "sub"), scratch)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "vslot", "sub", F.lit(version).alias("map_version"))


def op3(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "sub", "map_version")


def stage(spark, docs: DataFrame, sf_dir: str, shards: int = 8) -> DataFrame:
    """doc_id with its shard and position, for the documents as they arrive."""
    return shard(docs, shards)
