"""Sources and sinks."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelattice.functions import http, urls

FINGERPRINT = "r long, g long, b long, w int, h int"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The table of fetched pages."""
    return spark.read.parquet(path)


def pages_from_files(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(url, html) of page files: bytes as UTF-8, else ISO-8859-1; the file's path below ``prefix`` is the address."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.replace("path", F.lit(prefix), F.lit("")).alias("url"), http.decode_body("content").alias("html"))


def both(fetched: DataFrame, rendered: DataFrame) -> DataFrame:
    """Raw and rendered pages as one table."""
    return fetched.unionByName(rendered, allowMissingColumns=True)


def batch_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a batch file: lines without blanks and comments, with https where no scheme is given."""
    return batch_lines(spark.read.text(path))


def batch_lines(lines: DataFrame) -> DataFrame:
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.where((line != "") & ~line.startswith("#")).select(urls.typed_url(line).alias("url"))


def _sample(data: bytes, height: int, width: int, channels: int, mode_bgr: bool = True):
    """8 x 8 area means of each channel, premultiplied by alpha if there is one: (r, g, b) arrays."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        pixels = np.repeat(pixels, 3, axis=2)
    elif channels == 4:
        pixels = pixels[:, :, :3] * pixels[:, :, 3:] / 255
    rows, cols = (np.minimum(np.arange(n) * 8 // n, 7) for n in (height, width))
    out = np.zeros((8, 8, 3))
    count = np.zeros((8, 8, 1))
    np.add.at(out, (rows[:, None], cols[None, :]), pixels)
    np.add.at(count, (rows[:, None], cols[None, :]), 1)
    where = np.maximum(count, 1)
    means = (out / where).astype(np.int64)
    for axis, n in ((0, height), (1, width)):
        if n < 8:  # fewer pixels than cells: the nearest pixel's value
            take = np.arange(8) * n // 8 * 8 // n
            means = means.take(np.minimum(take, 7), axis=axis)
    return means[:, :, 2].ravel(), means[:, :, 1].ravel(), means[:, :, 0].ravel()


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in "rgb"]))
def channel_samples(image: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for h, w, n, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
        rows.append(_sample(data, h, w, n) if w and w > 0 else (None, None, None))
    return pd.DataFrame(rows, columns=["r", "g", "b"])


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, r, g, b) of image files; sides and hashes are null where a file can't be decoded.

    Decoding is Spark's image source; each channel is averaged over 8 x 8 cells
    (this package's own definition) and hashed on the JVM.
    """
    from sitelattice.functions.fingerprints import channel_hash

    rows = spark.read.format("image").load(path).select("image.*")
    rows = rows.select(F.col("origin").alias("path"), F.when(F.col("width") > 0, F.col("width")).alias("w"), F.when(F.col("height") > 0, F.col("height")).alias("h"), channel_samples(F.struct("height", "width", "nChannels", "data")).alias("s"))
    return rows.select("path", "w", "h", *(channel_hash(F.col(f"s.{c}")).alias(c) for c in "rgb"))


def write_media(files: DataFrame, path: str) -> None:
    """Files (folder, file_name, content) as a table; empty ones are errors and stay out."""
    files.where(F.length("content") > 0).select(F.concat_ws("/", "folder", "file_name").alias("path"), "content").write.mode("append").parquet(path)


def _write_partition(rows, root: str):
    import os

    for row in rows:
        target = os.path.join(root, row.path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as out:
            out.write(row.content)


def export_media(files: DataFrame, root: str) -> None:
    """The files themselves, in a folder that all executors mount (``root`` is a path there)."""
    files.where(F.length("content") > 0).select(F.concat_ws("/", "folder", "file_name").alias("path"), "content").foreachPartition(partial(_write_partition, root=root))


def write_details(sites: DataFrame, path: str) -> None:
    """``details.md`` texts of sites (studio, text), one row each, partitioned by studio."""
    sites.select("studio", F.col("text").alias("value")).write.mode("append").partitionBy("studio").text(path)


def write_queue(queue: DataFrame, path: str, current: str | None = None) -> None:
    """The job queue and the running job, in the place of what was stored before; ``jobs.restore`` reads them back."""
    from sitelattice.operators import jobs

    jobs.queue_rows(queue, current).write.mode("overwrite").parquet(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos long, url string, is_current boolean").parquet(path)


PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
