"""Crawling a page graph that is already a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.functions import constants as C


def shared_folder(spark, name: str) -> str:
    """A new path in the shared folder that the cluster names; in a temporary one where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def crawl(edges: DataFrame, starts: DataFrame, most: int = C.MAX_PAGES, max_depth: int | None = None) -> DataFrame:
    """(site, page, depth, visit_rank) of a first-in-first-out crawl from each site's start.

    ``edges(src, dst, pos)`` are links in page order, ``starts(site, page)``.  All
    sites go level by level together.  Within a level pages come in the order of
    their first discovery: by the parent's rank, then by the link's place.  A
    page is visited once, and a site stops at ``most`` pages, so a site's rows are
    bounded and a window over a site is small.  Pages deeper than ``max_depth`` are
    not visited.  Each level is written to the shared folder, which cuts the lineage.
    """
    spark, root = edges.sparkSession, shared_folder(edges.sparkSession, "crawl")
    level = starts.select("site", "page", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("visit_rank"))
    depth = 0
    while True:
        level.write.parquet(f"{root}/level={depth}")
        visited = spark.read.schema("site " + level.schema["site"].dataType.simpleString() + ", page " + level.schema["page"].dataType.simpleString() + ", depth int, visit_rank long").parquet(*(f"{root}/level={d}" for d in range(depth + 1)))
        frontier = visited.where(F.col("depth") == depth)
        if depth == max_depth or depth and frontier.isEmpty():
            return visited
        count = visited.groupBy("site").agg(F.count("*").alias("have"))
        found = frontier.join(edges, F.col("page") == F.col("src")).select("site", F.col("dst").alias("page"), F.struct("visit_rank", "pos").alias("seen"))
        found = found.groupBy("site", "page").agg(F.min("seen").alias("seen")).join(visited.select("site", "page"), ["site", "page"], "left_anti")
        order = Window.partitionBy("site").orderBy("seen", "page")
        found = found.withColumn("n", F.row_number().over(order)).join(count, "site").where(F.col("have") + F.col("n") <= most)
        depth += 1
        level = found.select("site", "page", F.lit(depth).alias("depth"), (F.col("have") + F.col("n") - 1).alias("visit_rank"))


def crawl_classic(links: DataFrame, starts: DataFrame, most: int = C.MAX_PAGES_CLASSIC) -> DataFrame:
    """(site, page): the start and the links of the start page only, by address, at most ``most`` pages."""
    found = starts.join(links, F.col("page") == F.col("src")).select("site", F.col("dst").alias("page")).where("page IS NOT NULL").distinct()
    found = found.join(starts, ["site", "page"], "left_anti")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page"))).where(F.col("n") < most)
    return starts.select("site", "page").union(ranked.select("site", "page"))


def unvisited(links: DataFrame, visited: DataFrame, pending: DataFrame) -> DataFrame:
    """Links that are neither visited nor pending."""
    return links.join(visited, "url", "left_anti").join(pending, "url", "left_anti").distinct()
