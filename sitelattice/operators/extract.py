"""Extraction: assets and links from pages.

Pages are rows of (url, html) and may carry what a browser saw, as array columns
``asset_candidates`` and ``link_candidates``.  All patterns ignore case.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelattice.functions import constants as C
from sitelattice.functions import urls


def attribute_values(html, name: str) -> Column:
    """Quoted values of an attribute on any tag; ``src`` is also found at the end of ``data-src``."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)\b{name}\s*=\s*["']([^"']+)["']"""))


def srcset_values(html, name: str) -> Column:
    """The addresses of a ``srcset``: the first token of each part."""
    parts = F.flatten(F.transform(attribute_values(html, name), lambda v: F.split(v, ",")))
    return F.filter(F.transform(parts, lambda p: F.split(F.ltrim(p), " ")[0]), lambda p: p != "")


def css_urls(html) -> Column:
    return F.regexp_extract_all(html, F.lit(C.CSS_URL))


def scanned_urls(html) -> Column:
    """Bare CDN and video addresses anywhere in the text (not part of the default)."""
    return F.flatten(F.array(*(F.regexp_extract_all(html, F.lit(p), F.lit(0)) for p in (C.WIX_SCAN, C.DATO_SCAN, C.VIDEO_SCAN))))


def sanity_urls(html) -> Column:
    """Addresses of image references, if the page names its project and dataset."""
    html = urls._text(html)
    project, dataset = F.regexp_extract(html, C.SANITY_PROJECT, 1), F.regexp_extract(html, C.SANITY_DATASET, 1)
    refs = F.array_distinct(F.regexp_extract_all(html, F.lit(C.SANITY_IMAGE)))
    part = lambda r, i: F.regexp_extract(r, C.SANITY_PARTS, i)
    made = F.transform(refs, lambda r: F.concat(F.lit("https://cdn.sanity.io/images/"), project, F.lit("/"), dataset, F.lit("/"), part(r, 1), F.lit("-"), part(r, 2), F.lit("."), part(r, 3)))
    return F.when((project != "") & (dataset != ""), made).otherwise(F.array().cast("array<string>"))


def raw_candidates(html, scan_cdn: bool = False) -> Column:
    """All raw values that may be assets, in no order and with repeats."""
    parts = [attribute_values(html, a) for a in C.ASSET_ATTRIBUTES] + [srcset_values(html, a) for a in C.SRCSET_ATTRIBUTES] + [css_urls(html)]
    return F.flatten(F.array(*parts, *([scanned_urls(html)] if scan_cdn else [])))


def found_assets(pages: DataFrame, scan_cdn: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, asset_url) with the page's columns ``keep``, distinct within each row of ``pages``: one pass, no shuffle."""
    raw = raw_candidates(F.col("html"), scan_cdn)
    if "asset_candidates" in pages.columns:
        raw = F.concat(raw, F.coalesce("asset_candidates", F.array().cast("array<string>")))
    # normalised inside the array: a filter on the exploded column would evaluate it twice
    normal = F.transform(F.array_distinct(raw), lambda v: urls.normalize(v, F.col("url")))
    found = F.array_distinct(F.filter(F.concat(normal, sanity_urls(F.col("html"))), lambda u: u.isNotNull()))
    return pages.select("url", *keep, F.explode(found).alias("asset_url"))


def page_assets(pages: DataFrame, scan_cdn: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, asset_url), distinct, with the page's columns ``keep``.

    One pass over the pages: raw values are made distinct within a page before
    they are normalised, and only (url, asset_url) pairs are shuffled.
    """
    return found_assets(pages, scan_cdn, keep).distinct()


def page_links(pages: DataFrame, site: str = "site_url", strict_origin: bool = False, keep: tuple[str, ...] = (), legacy: bool = False) -> DataFrame:
    """(url, link, pos): internal links in the order of the page; relative ones are resolved against the site's start."""
    raw = attribute_values(F.col("html"), "href")
    if "link_candidates" in pages.columns:
        raw = F.concat(F.coalesce("link_candidates", F.array().cast("array<string>")), raw)
    links = F.transform(raw, lambda v, i: F.struct(i.alias("pos"), urls.internal_link(v, F.col(site), F.col(site), strict_origin, legacy).alias("link")))
    rows = pages.select("url", *keep, F.explode(F.filter(links, lambda x: x["link"].isNotNull())).alias("x")).select("url", *keep, "x.*")
    return rows.groupBy("url", *keep, "link").agg(F.min("pos").alias("pos"))


def cargo_links(pages: DataFrame, site: str = "site_url") -> DataFrame:
    """(url, link): project pages that a Cargo page lists in its data."""
    html = F.col("html")
    marked = pages.where(F.contains(html, F.lit("cargo.site")) | F.contains(html, F.lit('"version":"Cargo2"')))
    raw = marked.select("url", site, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(C.PROJECT_URL)))).alias("raw"))
    raw = raw.withColumn("raw", urls.decode_entities(F.replace("raw", F.lit("\\/"), F.lit("/")))).where("raw NOT IN ('0', '')")
    return raw.select("url", urls.internal_link(F.col("raw"), F.col(site), F.col(site)).alias("link")).where("link IS NOT NULL").distinct()


def slugs(html, classic: bool = False) -> Column:
    """Distinct project slugs of a page, in order of appearance."""
    text = urls._text(html)
    text = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/")) if classic else text
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(C.SLUG)))
    return F.filter(found, lambda s: ~s.isin(*C.NAVIGATION_SLUGS) & (F.length(s) > 2))


def slug_links(pages: DataFrame, url_status: DataFrame, most: int | None = C.MAX_SLUGS, classic: bool = False) -> DataFrame:
    """(url, slug, link): for each slug the first template whose address answers 200.

    ``url_status(url, status)`` says what addresses answer.  Slugs have no slash, so an
    address that answers is cut into page, template and slug, the best template of
    each is kept, and page and slug are an equi-join: neither side is multiplied by
    the templates, and no estimate decides to send one to the driver.
    """
    found = slugs(F.col("html"), classic)
    found = F.slice(found, 1, most) if most else found
    base = F.regexp_replace(urls.path("url"), "^/+|/+$", "")
    prefix = F.concat(urls.origin("url"), F.when(base == "", "").otherwise(F.concat(F.lit("/"), base)))
    rows = pages.where(F.contains("html", F.lit("self.__next_f"))).select("url", prefix.alias("prefix"), F.explode(found).alias("slug"))
    fine = url_status.where("status = 200").select(F.col("url").alias("link"), F.regexp_extract("url", "([^/]*)$", 1).alias("slug")).where("slug <> ''")
    fine = fine.withColumn("above", F.expr("left(link, length(link) - length(slug))"))
    ends = F.array(*(F.when(F.col("above").endswith(p), F.struct(F.lit(i).alias("rank"), F.expr(f"left(above, length(above) - {len(p)})").alias("prefix"))) for i, p in enumerate(C.SLUG_PREFIXES)))
    fine = fine.select("slug", "link", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("x")).groupBy("x.prefix", "slug").agg(F.min("x.rank").alias("rank"))
    template = F.element_at(F.array(*(F.lit(p) for p in C.SLUG_PREFIXES)), F.col("rank") + 1)
    # a fixed number of partitions: merged by their packed bytes, such rows are many times larger in memory
    rows = rows.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "prefix", "slug")
    # an address has one prefix, so that these are its slugs, and they are where the join has put them
    return rows.join(fine.hint("merge"), ["prefix", "slug"]).groupBy("prefix", "slug", "url").agg(F.min("rank").alias("rank")).select("url", "slug", F.concat("prefix", template, "slug").alias("link"))


class _Classic(HTMLParser):
    """What the classic variant looks at: images, sources, videos, inline styles and scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.values: list[str] = []
        self.links: list[str] = []
        self.styles: list[str] = []
        self.scripts: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        have = {k: v or "" for k, v in attrs}
        wanted = {"img": ("src", "data-src", "data-lazy-src", "data-original"), "video": ("src", "data-src", "poster")}.get(tag, ())
        self.values += [have[a] for a in wanted if have.get(a)]
        for a in {"img": ("srcset", "data-srcset"), "source": ("src", "srcset")}.get(tag, ()):
            self.values += [p.split()[0] for p in have.get(a, "").split(",") if p.strip()]
        if tag == "a" and "href" in have:
            self.links.append(have["href"].strip())
        if have.get("style"):
            self.styles.append(have["style"])
        self.inside = tag == "script"

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.scripts.append(data)


_PARSED = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("values", "links")] + [T.StructField(n, T.StringType()) for n in ("styles", "scripts")])


@F.pandas_udf(_PARSED)
def parse_html(html: pd.Series) -> pd.DataFrame:
    """Tags' values by a real parser; patterns are then applied on the JVM."""
    rows = []
    for text in html.fillna(""):
        p = _Classic()
        p.feed(text)
        rows.append((p.values, p.links, "\n".join(p.styles), "\n".join(p.scripts)))
    return pd.DataFrame(rows, columns=["values", "links", "styles", "scripts"])


def classic_assets(pages: DataFrame) -> DataFrame:
    """(url, asset_url) by the classic rules: parsed tags, and CDN and video addresses in scripts."""
    parsed = pages.select("url", parse_html("html").alias("p")).select("url", "p.*")
    scripts = F.col("scripts")
    clean = F.replace(F.replace(scripts, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))
    whole = F.lit(0)
    ready = F.flatten(F.array(
        F.transform(F.regexp_extract_all("styles", F.lit(C.CSS_URL)), lambda v: urls.strip_cdn_query(urls.wix_original(v))),
        F.transform(F.regexp_extract_all(scripts, F.lit(C.CLASSIC_WIX_SCAN), whole), urls.wix_original),
        F.transform(F.regexp_extract_all(clean, F.lit(C.CLASSIC_DATO_SCAN), whole), lambda v: F.substring_index(v, "?", 1)),
        F.regexp_extract_all(scripts, F.lit(C.CLASSIC_VIDEO_SCAN), whole),
    ))
    normal = F.transform(F.col("values"), lambda v: urls.normalize(v, F.col("url"), classic=True))
    return parsed.select("url", F.explode(F.array_distinct(F.concat(normal, ready))).alias("asset_url")).where("asset_url IS NOT NULL")


def classic_links(pages: DataFrame) -> DataFrame:
    """(url, link) by the classic rules: anchors on the page's origin, without fragment, query and skipped parts."""
    parsed = pages.select("url", parse_html("html").alias("p"))
    rows = parsed.select("url", F.explode(F.array_distinct(F.transform("p.links", urls.strip))).alias("raw"))
    rows = rows.where(~F.col("raw").rlike(r"^(#|mailto:|tel:|javascript:)"))
    rows = rows.withColumn("link", urls.strip_fragment_and_query(urls.resolve(F.col("raw"), F.col("url"))))
    whole = F.regexp_extract("url", r"^([^:]+://[^/?#]*)", 1)
    skipped = F.rtrim(F.lower("link"), F.lit("/")).rlike("|".join(C.SKIPPED_LINK_PARTS))
    return rows.where(F.col("link").startswith(whole) & (F.rtrim("link", F.lit("/")) != F.rtrim("url", F.lit("/"))) & ~skipped).select("url", "link").distinct()


def json_scripts(html) -> Column:
    """The texts of a page's JSON scripts."""
    return F.regexp_extract_all(urls._text(html), F.lit(C.JSON_SCRIPT))


def cargo_slugs(pages: DataFrame) -> DataFrame:
    """(url, slug), distinct: the project pages that a Cargo page's JSON scripts name.

    An object lists them as ``pages[].project_url``, those with ``display: false`` left
    out; an array as ``[].url``.
    """
    data = pages.select("url", F.explode(json_scripts("html")).alias("json"))
    schema = "struct<pages: array<struct<project_url: string, display: boolean>>>"
    shown = F.filter(F.from_json("json", schema)["pages"], lambda p: F.coalesce(p["display"], F.lit(True)))
    listed = F.from_json("json", "array<struct<url: string>>")
    found = F.when(urls.strip("json").startswith("["), F.transform(listed, lambda x: x["url"])).otherwise(F.transform(shown, lambda p: p["project_url"]))
    return data.select("url", F.explode(found).alias("slug")).where("slug <> ''").distinct()


def cargo_images(pages: DataFrame) -> DataFrame:
    """(url, asset_url), distinct: a Cargo page's images on its own host, in attributes and as originals in its JSON scripts."""
    html = F.col("html")
    shown = F.transform(F.regexp_extract_all(html, F.lit(C.IMAGE_SOURCE)), lambda v: urls.resolve(v, F.col("url")))
    held = F.filter(F.concat(attribute_values(html, "data-src"), shown), lambda v: F.contains(v, F.lit(C.CARGO_HOST)) & ~v.rlike(r"\.(?:svg|ico)$"))
    originals = F.regexp_extract_all(F.array_join(json_scripts(html), "\n"), F.lit(C.CARGO_ORIGINAL), F.lit(0))
    return pages.select("url", F.explode(F.array_distinct(F.concat(held, originals))).alias("asset_url"))


def cargo_pages(slugs_: DataFrame, most: int = C.MAX_PAGES_CLASSIC) -> DataFrame:
    """(url, link): the project pages' addresses on the site's origin, at most ``most`` of a site, by name."""
    link = F.concat(urls.scheme("url"), F.lit("://"), F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1), F.lit("/"), F.regexp_replace("slug", "^/+", ""))
    rank = F.row_number().over(Window.partitionBy("url").orderBy("slug"))
    return slugs_.withColumn("_n", rank).where(F.col("_n") <= most).select("url", link.alias("link"))
