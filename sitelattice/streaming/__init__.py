"""Structured Streaming: the job queue, progress events and pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelattice.operators import extract

JOB_SCHEMA = "pos long, url string, is_current boolean"
EVENT_SCHEMA = "ts timestamp, site string, kind string, message string"
PAGE_SCHEMA = "page_id long, url string, html string"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs as files arrive; the checkpoint remembers which have been taken, so a restart loses none."""
    return spark.readStream.schema(JOB_SCHEMA).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).parquet(path)


def progress(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(window, site, kind, n): events by minute; those later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "site", "kind")
    return counted.agg(F.count("*").alias("n"))


def new_jobs(jobs: DataFrame) -> DataFrame:
    """Each address once, however often it is queued: keyed state of the addresses seen."""
    return jobs.dropDuplicates(["url"])


def page_assets(pages: DataFrame, scan_cdn: bool = False) -> DataFrame:
    """(url, asset_url) of arriving pages; made distinct within the stream."""
    return extract.page_assets(pages, scan_cdn)


def start(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True, every: str = "0.5 seconds") -> StreamingQuery:
    """Write a stream as Parquet: all there is now, or a batch every half second."""
    writer = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def cancel(query: StreamingQuery) -> None:
    """Stop a job's stream; what it has committed stays."""
    query.stop()
