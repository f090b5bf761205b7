"""Exact deduplication as a stateful stream over the files of a table.

The stream reads the table's files in micro-batches and keeps, for each SHA-256
digest, keyed state without expiry: how many rows it has seen, the stable
identifier of the row that stays and the content locators (file and row) of that
row and of the first one.  The state lives in RocksDB on the executors' disks
and in the shared checkpoint folder; a lost executor restores it from there.
Only map-side combined rows reach the state, so a group of copies of any size
is no burden.  The state is read back as a table when the stream has caught up.
With a ``checkpoint`` of its own the state outlives the run: a later run over the
same folder reads only the files that have come since and meets the digests of
all earlier ones.

On hits, that is for digests seen more than once, full bytes are checked: the
rows of those digests are read again and grouped by digest and whole text, again
map-side combined.  Texts with equal digests but other bytes become
groups of their own.

All of it is DataFrame and streaming functions, on the JVM.

Cases: a null text counts as an empty one and equals it.  A null identifier is
smaller than any other; repeated identifiers are rows of their own.  The row
with the largest identifier stays; of several such rows, the one with the
largest locator.  An empty table gives an empty result.  Extra columns are
neither read nor returned.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelattice.llm.runtime import Scratch, few_or_joined

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}

#: Files that one micro-batch takes.
FILES_PER_BATCH = 10_000


@contextmanager
def _state_conf(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(rows: DataFrame, digest) -> DataFrame:
    """doc_id, text (never null), digest and locator of each row."""
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")).withColumn("digest", digest(F.col("text").cast("binary")))


def _as_pattern(path: str) -> str:
    """The path as a glob pattern, as which it may also name a single file."""
    plain = path.rstrip("/")
    return plain if re.search(r"[{}\[\]*?\\]", plain) else f"{plain[:-1]}[{plain[-1]}]"


def run_stream(spark: SparkSession, path: str, scratch: Scratch, digest=sha256, files_per_batch: int = FILES_PER_BATCH, checkpoint: str | None = None) -> DataFrame:
    """(digest, n, keep struct<doc_id, at>, first) of every digest in the table, from the stream's state."""
    checkpoint = checkpoint or scratch.path("stream")
    listed = _as_pattern(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(listed)
    seen = _located(source, digest).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"), F.min("at").alias("first"))
    with _state_conf(spark):
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint).select("key.digest", "value.*")
        names = state.columns
        return scratch.keep(state.toDF("digest", *(["n", "keep", "first"] if len(names) == 4 else names[1:])), "state")


def dedup(spark: SparkSession, path: str, digest=sha256, files_per_batch: int = FILES_PER_BATCH, checkpoint: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of the table at ``path``.

    ``checkpoint`` keeps the stream's place and state between runs.
    """
    scratch = Scratch(spark, "exact-dedup")
    columns = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    if spark.read.parquet(path).isEmpty():
        return spark.read.parquet(path).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    state = run_stream(spark, path, scratch, digest, files_per_batch, checkpoint)
    rows = _located(spark.read.parquet(path), digest)

    # full bytes of the hits: read again, grouped by the bytes themselves
    hits = state.where("n > 1").select("digest")
    whole = scratch.keep(few_or_joined(rows, hits, ["digest"], hits.count()).groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep")).select("digest", F.xxhash64("text").alias("mark"), F.sha2("text", 256).alias("sha"), "n", "keep"), "checked")
    differ = whole.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    state = state.join(differ, "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("sha"), "n", "keep")
    clashing = whole.join(differ, "digest", "left_semi").select("digest", "sha", "n", "keep")
    few = clashing.isEmpty()
    narrow = rows.select("doc_id", "at", "digest", F.sha2("text", 256).alias("text_sha256") if digest is not sha256 else F.lower(F.hex("digest")).alias("text_sha256"))
    out = narrow.join(state, "digest")
    if not few:
        out = out.unionByName(narrow.join(clashing, (narrow.digest == clashing.digest) & (narrow.text_sha256 == clashing.sha)).drop(clashing.digest))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep.at")).alias("kept"), "text_sha256").select(*columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
