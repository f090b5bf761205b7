"""What the operators share: inputs, the shared scratch folder, folds, samples and components."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows of a few numbers each may be broadcast; the rows are counted first.
BROADCAST_ROWS = 1_000_000


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset on a local session (tests), a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        folder = _own.get(application) or _own.setdefault(application, f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return folder.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{label}"

    def keep(self, df: DataFrame, label: str = "part") -> DataFrame:
        """Write the rows and read them back."""
        path = self.path(label)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            self.delete(df.scratch_path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def crc(column: str | Column) -> Column:
    """Unsigned CRC-32 of the value's text in UTF-8; null counts as empty."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def fold(column: str, parts: int) -> Column:
    return crc(column) % parts


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, chosen by a seeded hash of ``key``: the same rows for the same table.

    A first filter on the hash leaves about twice ``most`` rows, so that the
    final ordering never sees more than that, whatever the table's size.
    """
    rank = F.xxhash64(F.col(key), F.lit(seed))
    total = df.count()
    if total > 4 * most:
        df = df.where(F.pmod(rank, F.lit(1 << 20)) < int((1 << 20) * 2.0 * most / total) + 1)
    return df.orderBy(rank, key).limit(most)


def own_names(columns: list[str]) -> list[str]:
    """Names for ``columns`` inside an operator that clash with nothing it adds."""
    return [f"_k{i}" for i in range(len(columns))]


def renamed(df: DataFrame, before: list[str], after: list[str]) -> list[Column]:
    """The columns ``before`` of ``df``, each under its name in ``after``."""
    return [df[f"`{b}`"].alias(a) for b, a in zip(before, after)]


def in_one_task(rows: DataFrame, order: list[Column], size: str, most_bytes: int, fit):
    """What ``fit`` makes of a bounded sample, computed by one task on an executor; None without rows.

    Rows come in ``order``; those behind the first ``most_bytes`` of the binary
    column ``size`` are left out, so the task's memory is bounded whatever the rows hold.
    The driver only ever sees the pickled result.
    """

    def task(batches):
        held, total = [], 0
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(size)).fill_null(0), np.int64)) + total
            fits = int(np.searchsorted(sizes, most_bytes, "right"))
            if fits:
                held.append(batch.slice(0, fits))
                total = int(sizes[fits - 1])
            if fits < len(sizes):
                break
        for _ in batches:  # to the end, so that the JVM's writer is not cut off
            pass
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(task, "model binary").collect()  # one row
    return pickle.loads(found[0].model) if found else None


def weight(df: DataFrame, array: str) -> int:
    """Rows of ``df``, or a quarter of its array's elements if those are more: what to hold against ``BROADCAST_ROWS``."""
    rows, elements = df.agg(F.count("*"), F.sum(F.size(array))).first()
    return max(rows, (elements or 0) // 4)


def few_or_joined(df: DataFrame, ids: DataFrame, on: list[str], n: int) -> DataFrame:
    """Inner join with a narrow side of ``n`` counted rows: broadcast if that is few, else shuffled."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge"), on)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], zero for empty ranges."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def segment_min(values: np.ndarray, first: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.minimum.reduceat(values, first[full])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: every node but the smallest of its component here, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for end in (a, b):
            np.minimum.at(after, root[end], low)
            np.minimum.at(after, end, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _contract(batches):
    """Edges (a, b) of a partition as stars."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in local_stars(*(np.concatenate(c) for c in zip(*held)))], ["a", "b"])


def _is_stars(graph: DataFrame) -> bool:
    """Whether every node has one link down or only links up."""
    ends = graph.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    wrong = ends.groupBy("v").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where("down > 1 OR (down = 1 AND least = 0)")
    return wrong.isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component), component the smallest node.

    Each round first turns the links within every partition into stars, without
    a shuffle; if the whole is not made of stars then, one large-star and one
    small-star step join a node's neighbours to its smallest neighbour.  That is
    found by an aggregate with map-side combine, so a node with very many links is
    never gathered in a task.  Every round is written to the shared folder and
    the one before deleted.  Nodes without links do not appear.
    """
    graph = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(rounds):
        stars = scratch.keep(graph.mapInArrow(_contract, "a long, b long").distinct(), "stars")
        scratch.drop(graph)
        if _is_stars(stars):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(stars.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        graph = scratch.keep(small, "edges")
        scratch.drop(stars)
    raise RuntimeError(f"components have not settled after {rounds} rounds")
