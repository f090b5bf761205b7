"""The job queue, its log and its totals as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.functions import constants as C
from sitelattice.operators.crawl import shared_folder


@dataclass(frozen=True)
class RunOptions:
    """What a run may be asked for; values out of bounds are refused."""

    max_images: int = C.MAX_IMAGES
    min_pixels: int = C.MIN_PIXELS
    organize: bool = True
    save_details: bool = False

    def __post_init__(self):
        low, high = C.MAX_IMAGES_RANGE
        if isinstance(self.max_images, bool) or not isinstance(self.max_images, int) or not low <= self.max_images <= high:
            raise ValueError(f"max_images is a whole number from {low} to {high}")
        if self.min_pixels < 0:
            raise ValueError("min_pixels is not negative")


def queue_rows(queue: DataFrame, current: str | None) -> DataFrame:
    """(pos, url, is_current): the waiting ``queue(position, url)`` and the job that runs, as ``restore`` takes them."""
    rows = queue.select(F.col("position").cast("long").alias("pos"), "url", F.lit(False).alias("is_current"))
    if current is None:
        return rows
    return rows.unionByName(queue.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit(current).alias("url"), F.lit(True).alias("is_current")))


def restore(jobs: DataFrame) -> DataFrame:
    """(position, url): the interrupted job first, then the saved queue, each address once.

    ``jobs(pos, url, is_current)``.
    """
    first = jobs.groupBy("url").agg(F.min(F.struct((~F.col("is_current")).alias("later"), "pos")).alias("at"))
    return positions(first, "at").select("position", "url")


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` numbered from 1 in an order.

    A queue is one list, but a long one is numbered in parallel: rows are dealt out
    by range, counted by partition, and each partition starts after those before it.
    The rows are written to the shared folder as they were dealt, with their partition
    and place: a second dealing may draw other bounds, and counts of the one would not
    fit rows of the other.
    """
    path = shared_folder(rows.sparkSession, "queue")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path).select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))  # a row for each partition
    return dealt.join(F.broadcast(ahead), "_part").withColumn("position", (F.col("_i") + F.col("_ahead") + 1).cast("int")).drop("_part", "_at", "_i", "_ahead")


def move_before(queue: DataFrame, moved: str, target: str) -> DataFrame:
    """``queue(position, url)`` after one job has been moved to the place of another."""
    place = queue.agg(F.max(F.when(F.col("url") == moved, F.col("position"))).alias("m"), F.max(F.when(F.col("url") == target, F.col("position"))).alias("t"))
    rows = queue.crossJoin(F.broadcast(place))  # one row
    before = F.when(F.col("m") < F.col("t"), F.col("t") + 0.5).otherwise(F.col("t") - 0.5)
    key = F.when((F.col("url") == moved) & F.col("t").isNotNull(), before).otherwise(F.col("position").cast("double"))
    return positions(rows.select("url", key.alias("k")), "k").select("position", "url")


def remove(queue: DataFrame, *urls: str) -> DataFrame:
    return queue.where(~F.col("url").isin(*urls))


def next_job(queue: DataFrame) -> DataFrame:
    return queue.agg(F.min_by("url", "position").alias("url"))


def log_tail(log: DataFrame, kept: int = C.LOG_KEPT, shown: int | None = None) -> DataFrame:
    """The last lines of ``log(seq, line)``; with ``shown``, the newest of those kept, newest first."""
    tail = log.orderBy(F.desc("seq")).limit(kept)
    return tail if shown is None else tail.orderBy(F.desc("seq")).limit(shown)


def totals(results: DataFrame) -> DataFrame:
    """One row of totals over ``results(found, saved, errors, failed)``; a failed job counts as one failure."""
    return results.agg(
        F.sum("found").alias("found"), F.sum("saved").alias("saved"),
        F.sum(F.when(F.col("failed"), F.lit(1)).otherwise(F.col("errors"))).alias("failed"),
    )
