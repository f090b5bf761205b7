"""Selection: one variant for each asset, one referer, filters by kind and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.functions import constants as C
from sitelattice.functions import urls


def largest_variants(assets: DataFrame, by: tuple[str, ...] = (), cargo: bool = True, ordered: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each key the variant with the highest score: then without query, shorter, first in order.

    ``assets`` has asset_url and the columns ``by``.  ``min_by`` is aggregated before
    the shuffle, so a key with very many variants does no harm.  ``ordered`` asks for
    the rows in the order of ``by`` and address; ``keep`` are columns of the variant that come along.
    """
    # sizes are columns of their own, so that each is found once however often the score names it
    sizes = urls.promised_sizes("asset_url")
    found = assets.select(*by, "asset_url", *keep, *(c.alias(f"_{n}") for n, c in sizes.items()))
    score = urls.score_of_sizes({n: F.col(f"_{n}") for n in sizes}, cargo)
    scored = found.select(*by, "asset_url", *keep, urls.canonical_key("asset_url", cargo).alias("asset_key"), score.alias("score"))
    order = F.struct(-F.col("score"), urls.has_query("asset_url"), F.length("asset_url"), F.col("asset_url"))
    best = F.min_by(F.struct("asset_url", "score", *keep), order)
    out = scored.groupBy(*by, "asset_key").agg(best.alias("best")).select(*by, "asset_key", F.col("best.asset_url").alias("asset_url"), F.col("best.score").alias("score"), *(F.col(f"best.{c}").alias(c) for c in keep))
    return out.orderBy(*by, "asset_url") if ordered else out


def best_referer(candidates: DataFrame, by: tuple[str, ...] = (), first_wins: bool = False) -> DataFrame:
    """For each asset the page with the highest priority; of equals the first visited.

    ``candidates`` has asset_url, page_url, visit_rank.  ``first_wins`` is the older rule.
    """
    priority = F.lit(0).cast("long") if first_wins else urls.referer_priority("page_url")
    return candidates.groupBy(*by, "asset_url").agg(F.min_by("page_url", F.struct(-priority, F.col("visit_rank"), F.col("page_url"))).alias("page_url"))


def upgrade_uploads(assets: DataFrame, referers: DataFrame | None, by: tuple[str, ...] = (), carry_referer: bool = False) -> DataFrame:
    """Assets with uploads at full size, and their referers.

    By default a referer is looked up by the upgraded address, so upgraded assets
    mostly have none; ``carry_referer`` keeps that of the address found.  Without
    ``referers``, ``assets`` has them.
    """
    found = assets.join(referers, [*by, "asset_url"], "left") if carry_referer and referers is not None else assets
    found = found.withColumn("asset_url", urls.wordpress_original("asset_url"))
    if carry_referer:
        return found.groupBy(*by, "asset_url").agg(F.min("page_url").alias("page_url"))
    return found.select(*by, "asset_url").distinct().join(referers, [*by, "asset_url"], "left")


def upgraded_with_referers(candidates: DataFrame, by: tuple[str, ...] = (), carry_referer: bool = False) -> DataFrame:
    """(asset_url, page_url) and ``by``: ``upgrade_uploads`` with each asset's ``best_referer``, as aggregates of one stream.

    ``candidates(asset_url, page_url, visit_rank)``, and the page's ``referer_priority`` if it
    is known.  A page counts as a referer for the address that it names.  An address that was only named, and which no upgrade leads
    to, is not an asset.
    """
    if carry_referer:
        return upgrade_uploads(best_referer(candidates, by), None, by, carry_referer=True)
    sent = lambda url, page, kept: F.struct(F.col(url).alias("asset_url"), page.alias("page_url"), F.lit(kept).alias("kept"))
    page = F.col("page_url")
    both = F.array(sent("_full", F.lit(None).cast("string"), True), sent("asset_url", page, False))
    rows = candidates if "referer_priority" in candidates.columns else candidates.withColumn("referer_priority", urls.referer_priority("page_url"))
    rows = rows.withColumn("_full", urls.wordpress_original("asset_url"))
    rows = rows.select(*by, "visit_rank", "referer_priority", F.explode(F.when(F.col("_full") == F.col("asset_url"), F.array(sent("asset_url", page, True))).otherwise(both)).alias("x")).select(*by, "visit_rank", "referer_priority", "x.*")
    order = F.when(page.isNotNull(), F.struct(-F.col("referer_priority"), F.col("visit_rank"), page))
    return rows.groupBy(*by, "asset_url").agg(F.min_by("page_url", order).alias("page_url"), F.bool_or("kept").alias("kept")).where("kept").drop("kept")


def first_by_path(assets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first address, in order, of each URL path, whatever its host."""
    return assets.groupBy(*by, urls.path("asset_url").alias("path")).agg(F.min("asset_url").alias("asset_url"))


def media_kind(url, classic: bool = False) -> Column:
    """``video`` by extension, anything else ``image``; the classic variant knows ``other``."""
    ext = urls.extension(url)
    other = F.when(ext.isin(*C.IMAGE_EXTENSIONS) | (ext == ""), "image").otherwise("other") if classic else F.lit("image")
    return F.when(ext.isin(*C.VIDEO_EXTENSIONS), "video").otherwise(other)


def is_small(width, height, least: int = C.MIN_PIXELS) -> Column:
    """Whether the longer side is too short; an image without known sides is."""
    return F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))) < least


def is_large(declared, actual, most: int = C.MAX_VIDEO_BYTES) -> Column:
    return (F.coalesce(declared, F.lit(0)) > most) | (F.coalesce(actual, F.lit(0)) > most)


def outcome(kind: Column, width: Column, height: Column, declared: Column, actual: Column, least: int = C.MIN_PIXELS, keep_small: bool = False) -> Column:
    """``small``, ``large``, ``error`` (no bytes) or ``ok`` for a fetched asset."""
    video = F.when(F.coalesce(declared, F.lit(0)) > C.MAX_VIDEO_BYTES, "large").when(F.coalesce(actual, F.lit(0)) == 0, "error").when(actual > C.MAX_VIDEO_BYTES, "large").otherwise("ok")
    image = F.when(F.coalesce(actual, F.lit(0)) == 0, "error").when(F.lit(not keep_small) & is_small(width, height, least), "small").otherwise("ok")
    return F.when(kind == "video", video).otherwise(image)


def fetched(attempts: DataFrame) -> DataFrame:
    """The first successful attempt for each asset: (asset_url, content, mime, via).

    ``attempts(asset_url, attempt, via, status, content, mime)`` are those that were
    made, direct ones first, then by other means; the first that brought something counts.
    """
    good = attempts.where(F.col("status").between(200, 399) & F.col("content").isNotNull())
    return good.groupBy("asset_url").agg(F.min_by(F.struct("content", "mime", "via"), F.struct("attempt", "content")).alias("a")).select("asset_url", "a.*")
