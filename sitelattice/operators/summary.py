"""A site's run from pages to its summary, as one plan for all sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.functions import names, urls
from sitelattice.operators import extract, select


def is_cargo(html) -> Column:
    return F.contains(html, F.lit("cargo.site"))


def platforms(pages: DataFrame) -> DataFrame:
    """(site, platform): ``Cargo`` if any start page says so."""
    return pages.groupBy("site").agg(F.when(F.bool_or(is_cargo(F.col("html"))), "Cargo").otherwise("Standard").alias("platform"))


def counters(fetches: DataFrame) -> DataFrame:
    """(site, found, saved, skipped_small, skipped_large, errors) from ``fetches(site, outcome)``."""
    of = lambda x: F.count_if(F.col("outcome") == x)
    return fetches.groupBy("site").agg(F.count("*").alias("found"), of("ok").alias("saved"), of("small").alias("skipped_small"), of("large").alias("skipped_large"), of("error").alias("errors"))


def summary_line(studio, saved, small, large, errors, platform) -> Column:
    return F.format_string("%s: %d saved, %d small skipped, %d large skipped, %d errors (%s)", studio, saved, small, large, errors, platform)


def details(studio, url) -> Column:
    """The text of a site's ``details.md``."""
    return F.concat(F.lit("# "), studio, F.lit("\n\n"), url)


def assets_of_sites(pages: DataFrame, scan_cdn: bool = False, carry_referer: bool = False) -> DataFrame:
    """(site, asset_key, asset_url, score, page_url): one variant of each asset with its best referer.

    ``pages(site, url, html, visit_rank)``.  Every step is keyed by site and asset.
    There are no joins: what a page has is sent once to the address that it is kept
    under, and once more, as a referer only, to the address found if that is another.
    """
    by = ("site",)
    ranked = pages.withColumn("referer_priority", urls.referer_priority("url"))  # once for a page, not for each of its assets
    found = extract.found_assets(ranked, scan_cdn, keep=("site", "visit_rank", "referer_priority")).withColumnRenamed("url", "page_url")
    return select.largest_variants(select.upgraded_with_referers(found, by, carry_referer), by, keep=("page_url",))


def site_summary(pages: DataFrame, **options) -> DataFrame:
    """(site, studio, platform, pages, candidates, videos): what a run would find on each site."""
    assets = assets_of_sites(pages, **options).groupBy("site").agg(F.count("*").alias("candidates"), F.count_if(select.media_kind("asset_url") == "video").alias("videos"))
    sites = pages.groupBy("site").agg(F.count("*").alias("pages"), F.when(F.bool_or(is_cargo(F.col("html"))), "Cargo").otherwise("Standard").alias("platform"))
    out = sites.join(assets.hint("merge"), "site", "left")  # sites may be many, which no size estimate sees
    zero = F.lit(0).cast("long")
    return out.select("site", names.studio_name(urls.start_url("site")).alias("studio"), "platform", "pages", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("videos", zero).alias("videos"))
