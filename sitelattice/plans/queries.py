"""Queries over the test tables, one or more for each operator, and SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelattice.functions import constants as C
from sitelattice.functions import fingerprints, http, names, urls
from sitelattice.operators import crawl, dedupe, extract, jobs, select, summary
from sitelattice.plans.inputs import derived, sql
from sitelattice.sources import batch_lines

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(text: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = sql(text)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _part(x: str, i: int) -> str:
    """DuckDB: scheme 1, authority 2, path 3, query 4 of a URL."""
    return rf"regexp_extract({x}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', {i})"


def _attr(name: str, html: str = "html") -> str:
    return rf"""regexp_extract_all({html}, '(?is)\b{name}\s*=\s*["'']([^"'']+)["'']', 1)"""


_NON_PAGE = ", ".join(f"'{e}'" for e in C.NON_PAGE_EXTENSIONS)


def _ext(x: str) -> str:
    return rf"lower(regexp_extract({_part(x, 3)}, '[^./]\.([^./]+)$', 1))"


# ---- extraction ----


@_query(f"SELECT DISTINCT page_id, unnest({_attr('href')}) AS value FROM <site_pages>")
def attribute_values(spark, sf_dir):
    return derived(spark, sf_dir, "site_pages").select("page_id", F.explode(extract.attribute_values("html", "href")).alias("value")).distinct()


@_query(f"""
WITH raw AS (SELECT page_id, unnest(flatten([{_attr('src')}, {_attr('data-src')}, {_attr('data-lazy-src')}, {_attr('data-original')}, {_attr('poster')}])) AS value FROM <rich_pages>),
sets AS (SELECT page_id, unnest(list_concat({_attr('srcset')}, {_attr('data-srcset')})) AS v FROM <rich_pages>),
parts AS (SELECT page_id, ltrim(unnest(string_split(v, ','))) AS p FROM sets)
SELECT page_id, value FROM raw UNION SELECT page_id, string_split(p, ' ')[1] FROM parts WHERE p <> ''
UNION SELECT page_id, unnest(regexp_extract_all(html, '(?i)url\\(["'']?(https://[^"'')\\s]+)["'']?\\)', 1)) FROM <rich_pages>""")
def raw_candidates(spark, sf_dir):
    return derived(spark, sf_dir, "rich_pages").select("page_id", F.explode(extract.raw_candidates(F.col("html"))).alias("value")).distinct()


@_query(r"""
SELECT DISTINCT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)https://static\.wixstatic\.com/media/[^\s"''<>]+'),
  list_concat(regexp_extract_all(html, '(?i)https://(?:www\.)?datocms-assets\.com/[^\s"''<>]+\.(?:jpg|jpeg|png|webp|avif|gif)'),
  regexp_extract_all(html, '(?i)https://[^\s"''<>]+\.(?:mp4|mov|webm|m4v)')))) AS value FROM <rich_pages>""")
def scanned_urls(spark, sf_dir):
    return derived(spark, sf_dir, "rich_pages").select("page_id", F.explode(extract.scanned_urls(F.col("html"))).alias("value")).distinct()


@_query(r"""
WITH r AS (SELECT page_id, regexp_extract(html, '"projectId"\s*:\s*"([a-z0-9]+)"', 1) AS project, regexp_extract(html, '"dataset"\s*:\s*"([a-z0-9_-]+)"', 1) AS dataset,
  unnest(regexp_extract_all(html, '(?i)image-[a-f0-9]+-\d+x\d+-(?:jpg|jpeg|png|webp|gif|avif)')) AS ref FROM <rich_pages>)
SELECT DISTINCT page_id, 'https://cdn.sanity.io/images/' || project || '/' || dataset || '/' || regexp_replace(ref, '^image-([a-f0-9]+)-(\d+x\d+)-([a-z0-9]+)$', '\1-\2.\3') AS value FROM r""")
def sanity_urls(spark, sf_dir):
    return derived(spark, sf_dir, "rich_pages").select("page_id", F.explode(extract.sanity_urls("html")).alias("value")).distinct()


@_query(rf"""
WITH sets AS (SELECT url, site, unnest({_attr('srcset')}) AS v FROM <rich_pages>), parts AS (SELECT url, site, unnest(string_split(v, ',')) AS v FROM sets),
raw AS (SELECT url, site, unnest(list_concat({_attr('src')}, list_concat({_attr('data-src')}, {_attr('poster')}))) AS v FROM <rich_pages>
  UNION SELECT url, site, string_split(ltrim(v), ' ')[1] FROM parts
  UNION SELECT url, site, unnest(regexp_extract_all(html, '(?i)url\(["'']?(https://[^"'')\s]+)["'']?\)', 1)) FROM <rich_pages>),
done AS (SELECT url, replace(CASE WHEN v LIKE 'http%' THEN regexp_replace(v, '^(https://cdn\.sanity\.io/[^?]*)\?.*$', '\1') WHEN v LIKE '/%' THEN rtrim(site, '/') || v
    WHEN v LIKE '../%' THEN site || substr(v, 4) ELSE site || 'work/' || v END, '&amp;', '&') AS asset_url FROM raw)
SELECT DISTINCT url, asset_url FROM done
UNION SELECT url, 'https://cdn.sanity.io/images/abc1/prod/' || regexp_extract(html, 'image-(a\d+)-100x200-jpg', 1) || '-100x200.jpg' FROM <rich_pages>""")
def page_assets(spark, sf_dir):
    return extract.page_assets(derived(spark, sf_dir, "rich_pages"))


@_query(rf"""
WITH raw AS (SELECT url, site_url, unnest({_attr('href')}) AS h, generate_subscripts({_attr('href')}, 1) - 1 AS pos FROM <site_pages>),
full_ AS (SELECT url, site_url, pos, CASE WHEN replace(h, '&amp;', '&') LIKE '/%' THEN rtrim(site_url, '/') || replace(h, '&amp;', '&') ELSE replace(h, '&amp;', '&') END AS u FROM raw),
ok AS (SELECT url, regexp_replace(u, '[?#].*$', '') AS link, pos FROM full_ WHERE starts_with(u, rtrim(site_url, '/')) AND u <> site_url AND {_ext('u')} NOT IN ({_NON_PAGE}))
SELECT url, link, min(pos)::INT AS pos FROM ok GROUP BY url, link""")
def internal_links(spark, sf_dir):
    return extract.page_links(derived(spark, sf_dir, "site_pages"))


@_query(rf"""
WITH raw AS (SELECT url, site_url, unnest({_attr('href')}) AS h, generate_subscripts({_attr('href')}, 1) - 1 AS pos FROM <site_pages>),
full_ AS (SELECT url, site_url, pos, CASE WHEN replace(h, '&amp;', '&') LIKE '/%' THEN rtrim(site_url, '/') || replace(h, '&amp;', '&') ELSE replace(h, '&amp;', '&') END AS u FROM raw),
ok AS (SELECT url, regexp_replace(u, '[?#].*$', '') AS link, pos FROM full_ WHERE starts_with(u, rtrim(site_url, '/')) AND u <> site_url AND {_ext('u')} NOT IN ({_NON_PAGE})
  AND NOT regexp_matches(lower(u), '/about|/contact|/privacy|/legal|/terms|/policy|/jobs|/careers|/feed|/tag/|/category/'))
SELECT url, link, min(pos)::INT AS pos FROM ok GROUP BY url, link""")
def legacy_internal_links(spark, sf_dir):
    return extract.page_links(derived(spark, sf_dir, "site_pages"), legacy=True)


@_query(r"""
WITH p AS (SELECT url, site_url, regexp_extract(html, 'src="/i/(\d+)', 1) AS k, asset_candidates[2] AS c FROM <rendered_pages>)
SELECT url, site_url || 'i/' || k || '.jpg' AS asset_url FROM p UNION SELECT url, rtrim(site_url, '/') || trim(c, chr(10) || ' ') FROM p""")
def rendered_assets(spark, sf_dir):
    return extract.page_assets(derived(spark, sf_dir, "rendered_pages"))


@_query(r"""
SELECT url, string_split(link_candidates[1], '#')[1] AS link, 0::INT AS pos FROM <rendered_pages>
UNION ALL SELECT url, rtrim(site_url, '/') || regexp_extract(html, 'href="([^"]+)"', 1), 2 FROM <rendered_pages>""")
def rendered_links(spark, sf_dir):
    return extract.page_links(derived(spark, sf_dir, "rendered_pages"))


@_query(r"""
WITH s AS (SELECT url, site, unnest(regexp_extract_all(html, '(?is)"project_url"\s*:\s*"([^"]+)"', 1)) AS raw FROM <rich_pages>)
SELECT DISTINCT url, site || replace(raw, chr(92) || '/', '/') AS link FROM s""")
def cargo_links(spark, sf_dir):
    return extract.cargo_links(derived(spark, sf_dir, "rich_pages").withColumnRenamed("site", "site_url"))


_STATUS = """SELECT DISTINCT url || t || slug AS url, CASE WHEN length(t) % 3 = 0 OR slug = 'proj-4' THEN 404 ELSE 200 END AS status
  FROM (SELECT DISTINCT url, regexp_extract(html, '"slug":"(proj-[0-9]+)"', 1) AS slug FROM {rich}) AS r
  CROSS JOIN (SELECT '/work/' AS t UNION ALL SELECT '/works/' UNION ALL SELECT '/projects/' UNION ALL SELECT '/case-study/') AS x"""


@_query(rf"""
WITH st AS ({_STATUS.format(rich='<rich_pages>')}),
s AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, '"slug"\s*:\s*"([a-z0-9][a-z0-9\-]+)"', 1))) AS slug FROM <rich_pages>),
c AS (SELECT s.url, slug, k, s.url || t || slug AS link FROM s CROSS JOIN (VALUES (0, '/work/'), (1, '/works/'), (2, '/projects/'), (3, '/case-studies/'), (4, '/case-study/'), (5, '/portfolio/')) AS x(k, t) WHERE slug <> 'about')
SELECT c.url, slug, arg_min(link, k) AS link FROM c JOIN st ON st.url = link AND st.status = 200 GROUP BY c.url, slug""")
def slug_links(spark, sf_dir):
    pages = derived(spark, sf_dir, "rich_pages")
    return extract.slug_links(pages, spark.sql(_STATUS, rich=pages))


_SLUG_STATUS = """SELECT url || CASE WHEN i % 2 = 0 THEN '/work/' ELSE '/portfolio/' END || 's-' || lpad(CAST(i AS STRING), 2, '0') AS url, CASE WHEN i % 5 = 4 THEN 404 ELSE 200 END AS status
  FROM {pages} AS p CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (26), (27), (28), (29)) AS v(i)"""
_MANY_SLUGS = rf"""
WITH st AS ({_SLUG_STATUS.format(pages='<slug_pages>')}),
s AS (SELECT url, unnest(list_filter(regexp_extract_all(html, '"slug":"([a-z0-9][a-z0-9\-]+)"', 1), lambda x: x <> 'about' AND length(x) > 2)[1:{{0}}]) AS slug FROM <slug_pages>),
c AS (SELECT s.url, slug, k, s.url || t || slug AS link FROM s CROSS JOIN (VALUES (0, '/work/'), (1, '/works/'), (2, '/projects/'), (3, '/case-studies/'), (4, '/case-study/'), (5, '/portfolio/')) AS x(k, t))
SELECT c.url, slug, arg_min(link, k) AS link FROM c JOIN st ON st.url = link AND st.status = 200 GROUP BY c.url, slug"""


@_query(_MANY_SLUGS.replace("{0}", "24"))
def slug_links_capped(spark, sf_dir):
    pages = derived(spark, sf_dir, "slug_pages")
    return extract.slug_links(pages, spark.sql(_SLUG_STATUS, pages=pages))


@_query(_MANY_SLUGS.replace("{0}", "100"))
def classic_slug_links(spark, sf_dir):
    pages = derived(spark, sf_dir, "slug_pages")
    escaped = pages.withColumn("html", F.replace("html", F.lit('"'), F.lit('\\"')))
    return extract.slug_links(escaped, spark.sql(_SLUG_STATUS, pages=pages), most=None, classic=True)


_CARGO_SLUGS = r"""s AS (SELECT url, unnest([regexp_extract(html, '"project_url":"(p\d)"', 1), regexp_extract(html, '"project_url":"(q\d)"', 1), regexp_extract(html, '"url":"(thumb\d)"', 1)]) AS slug FROM <cargo_pages>)"""


@_query(f"WITH {_CARGO_SLUGS} SELECT url, slug FROM s")
def cargo_slugs(spark, sf_dir):
    return extract.cargo_slugs(derived(spark, sf_dir, "cargo_pages"))


@_query(f"WITH {_CARGO_SLUGS} SELECT url, regexp_replace(url, 'a$', '') || slug AS link FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY slug) <= 2")
def cargo_project_pages(spark, sf_dir):
    return extract.cargo_pages(extract.cargo_slugs(derived(spark, sf_dir, "cargo_pages")), 2)


@_query(r"""SELECT url, regexp_extract(html, '(https://freight.cargo.site/w/100/[^"]+)', 1) AS asset_url FROM <cargo_pages>
UNION ALL SELECT url, regexp_extract(html, '(https://freight.cargo.site/t/original/[^"]+)', 1) FROM <cargo_pages>""")
def cargo_images(spark, sf_dir):
    return extract.cargo_images(derived(spark, sf_dir, "cargo_pages"))


@_query(r"""
WITH p AS (SELECT url, site, html, regexp_extract(html, 'src="/i/(\d+)', 1)::INT AS k FROM <rich_pages>)
SELECT url, unnest([site || 'i/' || k || '.jpg', site || 'l/' || k || '.png', site || 'a' || (k % 7) || '.jpg?w=100&v=1', site || 'a' || (k % 7) || '.jpg?w=900&v=1', site || 'p' || k || '.jpg',
  site || 'work/clip' || (k % 3) || '.mp4', 'https://cdn.sanity.io/images/p/d/' || (k % 5) || '-10x10.jpg', 'https://static.wixstatic.com/media/ab' || (k % 4) || '~mv2.jpg']) AS asset_url FROM p""")
def classic_assets(spark, sf_dir):
    return extract.classic_assets(derived(spark, sf_dir, "rich_pages"))


@_query(r"""
WITH p AS (SELECT url, site, regexp_extract(html, 'href="/work/n(\d+)', 1) AS k FROM <rich_pages>)
SELECT url, site || 'work/n' || k AS link FROM p UNION SELECT url, site || 'work/x.pdf' FROM p""")
def classic_links(spark, sf_dir):
    return extract.classic_links(derived(spark, sf_dir, "rich_pages"))


# ---- URL functions ----


@_query(r"""
WITH t AS (SELECT id, base, trim(raw, chr(9) || chr(10) || chr(13) || ' ') AS raw, regexp_replace(base, '/a/b/c.html$', '') AS root FROM <raw_urls>)
SELECT id, CASE id % 12 WHEN 0 THEN root || raw WHEN 1 THEN 'https:' || raw WHEN 3 THEN root || '/a/' || substr(raw, 4) WHEN 4 THEN root || '/a/b/same.webp' WHEN 5 THEN string_split(raw, '?')[1]
  WHEN 7 THEN regexp_replace(raw, '/v1/.*$', '') WHEN 8 THEN root || '/media/pic' || id || '.jpg' WHEN 9 THEN root || '/a/b/' || replace(raw, '&amp;', '&') WHEN 11 THEN base || raw END AS normal FROM t""")
def normalize_urls(spark, sf_dir):
    return derived(spark, sf_dir, "raw_urls").select("id", urls.normalize("raw", F.col("base")).alias("normal"))


@_query(r"""
WITH t AS (SELECT id, base, trim(raw, chr(9) || chr(10) || chr(13) || ' ') AS raw, regexp_replace(base, '/a/b/c.html$', '') AS root FROM <raw_urls>)
SELECT id, CASE id % 12 WHEN 0 THEN root || raw WHEN 1 THEN 'https:' || raw WHEN 3 THEN root || '/a/' || substr(raw, 4) WHEN 4 THEN root || '/a/b/same.webp' WHEN 5 THEN string_split(raw, '?')[1]
  WHEN 7 THEN regexp_replace(raw, '/v1/.*$', '') WHEN 8 THEN '/media/pic' || id || '.jpg' WHEN 9 THEN root || '/a/b/' || raw WHEN 11 THEN base || raw END AS normal FROM t""")
def normalize_urls_classic(spark, sf_dir):
    return derived(spark, sf_dir, "raw_urls").select("id", urls.normalize("raw", F.col("base"), classic=True).alias("normal"))


@_query(rf"""
SELECT page_id, {_part('url', 1)} AS scheme, {_part('url', 2)} AS host, {_part('url', 3)} AS path, nullif({_part('url', 4)}, '') AS query, {_ext('url')} AS extension,
  regexp_replace(url, '[?#].*$', '') AS bare, {_ext('url')} NOT IN ({_NON_PAGE}) AS is_page FROM pages""")
def url_parts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", *(f("url").alias(n) for n, f in (("scheme", urls.scheme), ("host", urls.host), ("path", urls.path), ("query", urls.query), ("extension", urls.extension), ("bare", urls.strip_fragment_and_query), ("is_page", urls.is_page))))


@_query(r"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://' || lower(c_mktsegment) || '.com/x' WHEN 1 THEN 'http://' || lower(c_mktsegment) || '.com/' ELSE 'https://' || lower(c_mktsegment) || '.com' END AS start,
  CASE c_custkey % 3 WHEN 1 THEN 'http://' || lower(c_mktsegment) || '.com/' WHEN 0 THEN 'https://' || lower(c_mktsegment) || '.com/x' ELSE 'https://' || lower(c_mktsegment) || '.com' END AS typed FROM customer""")
def start_urls(spark, sf_dir):
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) || '.com/x' WHEN 1 THEN 'http://' || lower(c_mktsegment) || '.com/' ELSE lower(c_mktsegment) || '.com' END")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", urls.start_url(F.concat("raw", F.when(F.col("c_custkey") % 2 == 0, "#frag").otherwise(""))).alias("start"), urls.typed_url(F.concat(F.lit(" "), "raw")).alias("typed"))


@_query(r"""SELECT DISTINCT asset_url, regexp_replace(asset_url, '(?i)^(https?://[^/]+/wp-content/uploads/\d{4}/\d{2}/)(.+?)(-\d+x\d+)(\.[a-z]+)$', '\1\2\4') AS original FROM <uploads>""")
def wordpress_originals(spark, sf_dir):
    return derived(spark, sf_dir, "uploads").select("asset_url", urls.wordpress_original("asset_url").alias("original")).distinct()


_KEY = rf"""
WITH u AS (SELECT DISTINCT asset_url, lower({_part('asset_url', 2)}) AS h, {_part('asset_url', 3)} AS p,
  list_filter(string_split({_part('asset_url', 4)}, '&'), lambda i: i <> '' AND lower(string_split(i, '=')[1]) NOT IN ({", ".join(f"'{s}'" for s in C.SIZE_PARAMETERS)})) AS items FROM <{{0}}>),
n AS (SELECT *, CASE WHEN h = 'freight.cargo.site' AND regexp_matches(p, '^/(?:w/\d+|t/original)/i/([^/]+)/(.+)$') THEN regexp_replace(p, '^/(?:w/\d+|t/original)/i/([^/]+)/(.+)$', '/i/\1/\2')
  ELSE regexp_replace(regexp_replace(regexp_replace(p, '-\d{{{{2,5}}}}x\d{{{{2,5}}}}(\.[a-zA-Z0-9]+)$', '\1'), '([/_-])w[_=-]?\d{{{{2,5}}}}([,_-]|/)', '\1', 'g'), '([/_-])h[_=-]?\d{{{{2,5}}}}([,_-]|/)', '\1', 'g') END AS q FROM u),
k AS (SELECT asset_url, 'https://' || h || q || '?' || array_to_string(list_sort(items), '&') AS asset_key FROM n)"""


@_query(_KEY.format("odd_variants").replace("{{", "{").replace("}}", "}") + " SELECT asset_url, asset_key FROM k")
def canonical_keys(spark, sf_dir):
    return derived(spark, sf_dir, "odd_variants").select("asset_url", urls.canonical_key("asset_url").alias("asset_key")).distinct()


_SCORE = r"""CASE WHEN lower(asset_url) LIKE '%freight.cargo.site/t/original/%' THEN 2305843009213693951
  WHEN w IS NOT NULL AND h IS NOT NULL THEN w * h WHEN pw IS NOT NULL THEN pw * ph WHEN w IS NOT NULL THEN w * w WHEN h IS NOT NULL THEN h * h ELSE 0 END"""
_SIZES = r"""s AS (SELECT asset_url,
  coalesce(try_cast(nullif(regexp_extract(lower(asset_url), '[?&](?:w|width)=(\d+)(?:$|[&#])', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(lower(asset_url), '(?:^|[?&/_,-])w(?:idth)?[_=-]?(\d{2,5})', 1), '') AS BIGINT)) AS w,
  coalesce(try_cast(nullif(regexp_extract(lower(asset_url), '[?&](?:h|height)=(\d+)(?:$|[&#])', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(lower(asset_url), '(?:^|[?&/_,-])h(?:eight)?[_=-]?(\d{2,5})', 1), '') AS BIGINT)) AS h,
  try_cast(nullif(regexp_extract(lower(asset_url), '(\d{2,5})x(\d{2,5})\.[a-z0-9]+(?:$|[?#])', 1), '') AS BIGINT) AS pw, try_cast(nullif(regexp_extract(lower(asset_url), '(\d{2,5})x(\d{2,5})\.[a-z0-9]+(?:$|[?#])', 2), '') AS BIGINT) AS ph
  FROM (SELECT DISTINCT asset_url FROM <odd_variants>))"""


@_query(f"WITH {_SIZES} SELECT asset_url, {_SCORE} AS score FROM s")
def resolution_scores(spark, sf_dir):
    return derived(spark, sf_dir, "odd_variants").select("asset_url", urls.resolution_score("asset_url").alias("score")).distinct()


@_query("""
WITH v AS (SELECT DISTINCT asset_url, regexp_replace(asset_url, '\\?w=\\d+&', '?') AS asset_key, regexp_extract(asset_url, 'w=(\\d+)', 1)::BIGINT AS w FROM <variants>)
SELECT asset_key, arg_max(asset_url, w) AS asset_url, max(w) * max(w) AS score FROM v GROUP BY asset_key""")
def variant_selection(spark, sf_dir):
    return select.largest_variants(derived(spark, sf_dir, "variants"))


@_query(_KEY.format("odd_variants").replace("{{", "{").replace("}}", "}") + f", {_SIZES}, " + f"""
r AS (SELECT asset_key, k.asset_url, {_SCORE} AS score FROM k JOIN s USING (asset_url))
SELECT asset_key, asset_url, score FROM r
QUALIFY row_number() OVER (PARTITION BY asset_key ORDER BY score DESC, (asset_url LIKE '%?%')::INT, length(asset_url), asset_url) = 1""")
def odd_variant_selection(spark, sf_dir):
    return select.largest_variants(derived(spark, sf_dir, "odd_variants"))


_PRIORITY = f"""CASE WHEN {_part('page_url', 3)} LIKE '%{{{{%' THEN -2305843009213693952 WHEN {_part('page_url', 3)} LIKE '%/feed' THEN -100 WHEN {_ext('page_url')} IN ({_NON_PAGE}) THEN -200
  WHEN {_part('page_url', 3)} IN ('', '/') THEN 0 ELSE 100 + least(length({_part('page_url', 3)}), 200) END"""


@_query(f"SELECT DISTINCT page_url, ({_PRIORITY})::BIGINT AS priority FROM <candidates>")
def referer_priorities(spark, sf_dir):
    return derived(spark, sf_dir, "candidates").select("page_url", urls.referer_priority("page_url").alias("priority")).distinct()


@_query(f"""
SELECT asset_url, page_url FROM <candidates> QUALIFY row_number() OVER (PARTITION BY asset_url ORDER BY {_PRIORITY} DESC, visit_rank, page_url) = 1""")
def best_referers(spark, sf_dir):
    return select.best_referer(derived(spark, sf_dir, "candidates"))


@_query("SELECT asset_url, page_url FROM <candidates> QUALIFY row_number() OVER (PARTITION BY asset_url ORDER BY visit_rank, page_url) = 1")
def first_referers(spark, sf_dir):
    return select.best_referer(derived(spark, sf_dir, "candidates"), first_wins=True)


@_query(r"""
WITH a AS (SELECT DISTINCT asset_url FROM <uploads>), up AS (SELECT DISTINCT regexp_replace(asset_url, '-\d+x\d+\.jpg$', '.jpg') AS asset_url FROM a)
SELECT up.asset_url, CASE WHEN a.asset_url IS NOT NULL THEN 'https://page.example.com/' END AS page_url FROM up LEFT JOIN a USING (asset_url)""")
def upgraded_uploads(spark, sf_dir):
    found = derived(spark, sf_dir, "uploads").distinct()
    return select.upgrade_uploads(found, found.withColumn("page_url", F.lit("https://page.example.com/")))


@_query(r"""
SELECT regexp_replace(asset_url, '-\d+x\d+\.jpg$', '.jpg') AS asset_url, min('https://page.example.com/' || length(asset_url)) AS page_url FROM <uploads> GROUP BY 1""")
def carried_referers(spark, sf_dir):
    found = derived(spark, sf_dir, "uploads").distinct()
    return select.upgrade_uploads(found, found.withColumn("page_url", F.concat(F.lit("https://page.example.com/"), F.length("asset_url").cast("string"))), carry_referer=True)


@_query(f"SELECT {_part('asset_url', 3)} AS path, min(asset_url) AS asset_url FROM <odd_variants> GROUP BY 1")
def path_dedupe(spark, sf_dir):
    return select.first_by_path(derived(spark, sf_dir, "odd_variants"))


@_query(r"""
SELECT DISTINCT asset_url, regexp_matches(lower(asset_url), 'favicon|avatar|1x1|blank|spacer|logo|icon') OR regexp_matches(lower(asset_url), '\.(svg|ico)$') AS skipped FROM <odd_variants>""")
def skipped_assets(spark, sf_dir):
    return derived(spark, sf_dir, "odd_variants").select("asset_url", urls.is_skipped("asset_url").alias("skipped")).distinct()


# ---- names ----


@_query(r"""
WITH c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(name, '[/:\\?%*|"<>\n\r]', '-', 'g'), '\s+', ' ', 'g'), '-{2,}', '-', 'g') AS n FROM <names>)
SELECT id, coalesce(nullif(trim(n, '. -_'), ''), 'file') AS base FROM c""")
def sanitized_names(spark, sf_dir):
    return derived(spark, sf_dir, "names").select("id", names.sanitize_base("name").alias("base"))


@_query(r"""
SELECT page_id, CASE WHEN regexp_replace(string_split(url, '/')[3], '^www\.', '') = '' THEN 'x' ELSE
  (SELECT trim(regexp_replace(upper(l[1]) || substr(l, 2) || coalesce(' ' || nullif(array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), ' '), ''), ''), '-{2,}', '-', 'g'), '. -_')
   FROM (SELECT string_split(replace(lower(string_split(url, '/')[3]), 'www.', ''), '.')[1] AS l, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS p)) END AS studio FROM pages""")
def studio_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names.studio_name("url").alias("studio"))


@_query(r"""SELECT page_id, replace(lower(string_split(url, '/')[3]), 'www.', '').string_split('.')[1] AS studio FROM pages""")
def studio_names_classic(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names.studio_name_classic("url").alias("studio"))


@_query(r"""
SELECT asset_url, mime, CASE WHEN asset_url LIKE '%.mp4' OR asset_url LIKE '%.webm' OR asset_url LIKE '%.jpg' OR asset_url LIKE '%.png' THEN regexp_extract(asset_url, '[^/]+$')
  ELSE regexp_extract(asset_url, '[^/]+$') || CASE mime WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END END AS name
FROM (SELECT asset_url, CASE WHEN w % 3 = 0 THEN 'image/webp' WHEN w % 3 = 1 THEN 'x/unknown' END AS mime FROM <images>)""")
def preferred_names(spark, sf_dir):
    rows = derived(spark, sf_dir, "images").select("asset_url", F.expr("CASE WHEN w % 3 = 0 THEN 'image/webp' WHEN w % 3 = 1 THEN 'x/unknown' END").alias("mime"))
    return rows.select("asset_url", "mime", names.preferred_filename("asset_url", "mime", "image").alias("name"))


@_query(r"""
SELECT page_id, trim(replace(string_split(url, '/')[3], 'www.', ''), '. -_') || '/' || coalesce(nullif(array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'),
  lambda x: x <> ''), lambda x: trim(x, '. -_')), '/'), ''), 'Home') AS folder FROM pages""")
def source_folders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names.source_directory("url").alias("folder"))


def _named_in_turn(first: str, nth: str, seen: str, least: int) -> str:
    """DuckDB: files of each folder named one after the other; ``first`` and ``nth`` (of k) are the names to try."""
    return rf"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY asset_url) AS i FROM <files>),
walk(folder, i, taken, asset_url, file_name) AS (
  SELECT DISTINCT folder, 0::BIGINT, ['']::VARCHAR[], '', '' FROM r
  UNION ALL
  SELECT folder, i, list_append(taken, {seen.format('pick')}), asset_url, pick FROM (
    SELECT folder, i, taken, asset_url, CASE WHEN NOT list_contains(taken, {seen.format(first)}) THEN {first}
      ELSE list_filter(list_transform(range({least}, len(taken) + 3), lambda k: {nth}), lambda x: NOT list_contains(taken, {seen.format('x')}))[1] END AS pick
    FROM (SELECT r.folder, r.i, walk.taken, r.asset_url, r.name, string_split(r.name, '.')[1] AS base FROM walk JOIN r ON r.folder = walk.folder AND r.i = walk.i + 1)))
SELECT folder, asset_url, file_name FROM walk WHERE i > 0"""


@_query(_named_in_turn("base || '.jpg'", "base || ' ' || k || '.jpg'", "lower({})", 2))
def unique_names(spark, sf_dir):
    return dedupe.unique_names(derived(spark, sf_dir, "files")).select("folder", "asset_url", "file_name")


@_query(_named_in_turn("name", "base || '_' || k || '.JPG'", "{}", 1))
def unique_names_classic(spark, sf_dir):
    return dedupe.unique_names(derived(spark, sf_dir, "files"), classic=True).select("folder", "asset_url", "file_name")


@_query(r"""
SELECT asset_url, CASE WHEN length(name) % 3 < 2 THEN folder || '/' || name ELSE name END AS path FROM <files>""")
def relative_paths(spark, sf_dir):
    rows = derived(spark, sf_dir, "files")
    root = F.expr("CASE length(name) % 3 WHEN 0 THEN '/out' WHEN 1 THEN '/out/' ELSE '/elsewhere' END")
    return rows.select("asset_url", names.relative_path(F.concat_ws("/", F.lit("/out"), "folder", "name"), root).alias("path"))


# ---- filters, counters and caps ----

_OUTCOME = """CASE WHEN regexp_matches(asset_url, '\\.(mp4|mov|webm|m4v|ogv)$') THEN CASE WHEN declared_len > 52428800 THEN 'large' WHEN len = 0 THEN 'error' WHEN len > 52428800 THEN 'large' ELSE 'ok' END
  WHEN len = 0 THEN 'error' WHEN greatest(w, h) < 900 THEN 'small' ELSE 'ok' END"""


def _outcomes(spark, sf_dir) -> DataFrame:
    rows = derived(spark, sf_dir, "images")
    return rows.withColumn("outcome", select.outcome(select.media_kind("asset_url"), F.col("w"), F.col("h"), F.col("declared_len"), F.col("len")))


@_query(f"SELECT site, asset_url, CASE WHEN regexp_matches(asset_url, '\\.(mp4|mov|webm|m4v|ogv)$') THEN 'video' ELSE 'image' END AS kind, {_OUTCOME} AS outcome FROM <images>")
def asset_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("site", "asset_url", select.media_kind("asset_url").alias("kind"), "outcome")


@_query(r"""SELECT asset_url, CASE WHEN regexp_matches(asset_url, '\.(mp4|webm)$') THEN 'video' WHEN regexp_matches(asset_url, '\.(jpg|png)$') OR NOT regexp_matches(asset_url, '/[^/]*\.[^/]*$') THEN 'image' ELSE 'other' END AS kind,
  greatest(w, h) < 1100 AS small FROM <images>""")
def classic_kinds(spark, sf_dir):
    return derived(spark, sf_dir, "images").select("asset_url", select.media_kind("asset_url", classic=True).alias("kind"), select.is_small(F.col("w"), F.col("h"), C.MIN_PIXELS_CLASSIC).alias("small"))


_HANDLED = r"""
k AS (SELECT *, CASE WHEN regexp_matches(asset_url, '\.(mp4|webm)$') THEN 'video' ELSE 'image' END AS kind FROM <downloads> WHERE NOT contains(asset_url, 'logo') AND NOT regexp_matches(asset_url, '\.bmp$')),
o AS (SELECT site, asset_url, kind, CASE WHEN kind = 'video' THEN CASE WHEN declared_len > 52428800 THEN 'large' WHEN len = 0 THEN 'error' ELSE 'ok' END
  WHEN len = 0 THEN 'error' WHEN w < 1100 AND h < 1100 THEN 'small' ELSE 'ok' END AS outcome FROM k),
r AS (SELECT *, coalesce(sum((outcome = 'ok')::INT) OVER (PARTITION BY site ORDER BY asset_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)"""


@_query(f"WITH {_HANDLED} SELECT site, asset_url, kind, outcome FROM r WHERE before < 10")
def classic_downloads(spark, sf_dir):
    return dedupe.classic_downloads(derived(spark, sf_dir, "downloads"), 10)


@_query(f"""
WITH {_HANDLED} SELECT site, count(*) AS found, count(*) FILTER (outcome = 'ok') AS saved, count(*) FILTER (outcome = 'small') AS skipped_small,
  count(*) FILTER (outcome = 'large') AS skipped_large, count(*) FILTER (outcome = 'error') AS errors FROM r WHERE before < 10 GROUP BY site""")
def classic_counters(spark, sf_dir):
    return summary.counters(dedupe.classic_downloads(derived(spark, sf_dir, "downloads"), 10))


@_query(f"""
WITH o AS (SELECT site, {_OUTCOME} AS outcome FROM <images>)
SELECT site, count(*) AS found, count(*) FILTER (outcome = 'ok') AS saved, count(*) FILTER (outcome = 'small') AS skipped_small,
  count(*) FILTER (outcome = 'large') AS skipped_large, count(*) FILTER (outcome = 'error') AS errors FROM o GROUP BY site""")
def run_counters(spark, sf_dir):
    return summary.counters(_outcomes(spark, sf_dir))


@_query(f"""
WITH o AS (SELECT site, {_OUTCOME} AS outcome FROM <images>),
c AS (SELECT site, count(*) AS found, count(*) FILTER (outcome = 'ok') AS saved, count(*) FILTER (outcome = 'error') AS errors FROM o GROUP BY site)
SELECT sum(found)::BIGINT AS found, sum(saved)::BIGINT AS saved, sum(CASE WHEN site = 'site3' THEN 1 ELSE errors END)::BIGINT AS failed FROM c""")
def job_totals(spark, sf_dir):
    return jobs.totals(summary.counters(_outcomes(spark, sf_dir)).withColumn("failed", F.col("site") == "site3"))


@_query(f"""
WITH o AS (SELECT site, asset_url, {_OUTCOME} AS outcome FROM <images>)
SELECT site, asset_url, position::INT AS position FROM (SELECT site, asset_url, row_number() OVER (PARTITION BY site ORDER BY asset_url) AS position FROM o WHERE outcome = 'ok') WHERE position <= 20""")
def capped_output(spark, sf_dir):
    return dedupe.capped(_outcomes(spark, sf_dir).where("outcome = 'ok'").select("site", "asset_url"), 20)


@_query(f"""
WITH o AS (SELECT site, {_OUTCOME} AS outcome FROM <images>)
SELECT site, site || ': ' || count(*) FILTER (outcome = 'ok') || ' saved, ' || count(*) FILTER (outcome = 'small') || ' small skipped, ' || count(*) FILTER (outcome = 'large') || ' large skipped, ' ||
  count(*) FILTER (outcome = 'error') || ' errors (Standard)' AS line, '# ' || site || chr(10) || chr(10) || 'https://' || site || '.com' AS details FROM o GROUP BY site""")
def summary_lines(spark, sf_dir):
    rows = summary.counters(_outcomes(spark, sf_dir))
    return rows.select("site", summary.summary_line("site", "saved", "skipped_small", "skipped_large", "errors", F.lit("Standard")).alias("line"), summary.details(F.col("site"), F.concat(F.lit("https://"), "site", F.lit(".com"))).alias("details"))


@_query("SELECT site_url AS site, CASE WHEN bool_or(contains(html, 'cargo.site')) THEN 'Cargo' ELSE 'Standard' END AS platform FROM <site_pages> GROUP BY site_url")
def platforms(spark, sf_dir):
    return summary.platforms(derived(spark, sf_dir, "site_pages").withColumnRenamed("site_url", "site"))


# ---- HTTP ----


@_query(r"""
SELECT id, (200 + id % 250)::INT AS status, CASE WHEN id % 3 = 0 THEN 'text/plain' ELSE regexp_extract(headers, 'Content-Type: +(\S+)', 1) END AS content_type, (200 + id % 250) BETWEEN 200 AND 399 AS success FROM <headers>""")
def response_headers(spark, sf_dir):
    status = http.last_status("headers")
    return derived(spark, sf_dir, "headers").select("id", status.alias("status"), http.last_header("headers", "content-type").alias("content_type"), http.is_success(status).alias("success"))


@_query(r"""
SELECT DISTINCT asset_url, page_url, page_url AS referer, CASE WHEN asset_url LIKE 'https://a.example.com/1%' THEN 'https://s.example.com' END AS origin
FROM <candidates>""")
def request_headers(spark, sf_dir):
    rows = derived(spark, sf_dir, "candidates").select("asset_url", "page_url").distinct()
    near = F.when(F.col("asset_url").startswith("https://a.example.com/1"), F.replace("asset_url", F.lit("a.example"), F.lit("s.example"))).otherwise(F.col("asset_url"))
    return rows.select("asset_url", "page_url", http.request_headers(near, "page_url").alias("h")).select("asset_url", "page_url", "h.*")


@_query("SELECT asset_url, content, mime, via FROM <attempts> WHERE status = 200 QUALIFY row_number() OVER (PARTITION BY asset_url ORDER BY attempt, content) = 1")
def fetched_assets(spark, sf_dir):
    return select.fetched(derived(spark, sf_dir, "attempts"))


# ---- fingerprints ----

def _hashed(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("long"))
    return rows.select("vec_id", "label", fingerprints.channel_hash(scaled).alias("hash"))


_INT_HASH = """h AS (SELECT vec_id, label, sum(CASE WHEN v >= m THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0 END)::BIGINT AS hash
  FROM (SELECT vec_id, label, unnest(s) AS v, unnest(range(64)) AS i, floor(list_sum(s) / 64.0)::BIGINT AS m FROM (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT) AS s FROM embeddings)) GROUP BY vec_id, label)"""


@_query(f"WITH {_INT_HASH} SELECT vec_id, label, hash FROM h")
def channel_hashes(spark, sf_dir):
    return _hashed(spark, sf_dir)


_FAMILIES = """f AS (SELECT h.vec_id, h.label, xor(b.hash, (1::BIGINT << (3 * (h.vec_id % 5))) - 1) AS hash FROM h JOIN h AS b ON b.vec_id = h.vec_id - h.vec_id % 5)"""


def _families(spark, sf_dir) -> DataFrame:
    """Images in families of five whose hashes differ in 3 to 12 bits."""
    rows = _hashed(spark, sf_dir)
    base = rows.select(F.col("vec_id").alias("first"), F.col("hash").alias("own"))
    rows = rows.join(base, F.col("vec_id") - F.col("vec_id") % 5 == F.col("first"))
    mark = F.col("own").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vec_id") % 5 * 3).cast("int")) - 1)
    return rows.select(F.col("label").cast("string").alias("site"), F.concat(F.lit("v"), (F.col("vec_id") + 100000).cast("string")).alias("asset_url"), *(mark.alias(c) for c in "rgb"), (F.col("vec_id") * 7 % 97 + 900).cast("int").alias("w"), F.lit(900).alias("h"))


@_query(f"WITH {_INT_HASH}, {_FAMILIES}, c AS (SELECT hash, min('v' || (100000 + vec_id)) AS rep FROM f GROUP BY hash) SELECT a.rep AS a, b.rep AS b FROM c a JOIN c b ON a.rep < b.rep AND bit_count(xor(a.hash, b.hash)) <= 8")
def near_pairs(spark, sf_dir):
    return dedupe.near_pairs(dedupe.fingerprint_classes(_families(spark, sf_dir)))


@_query(f"WITH {_INT_HASH}, {_FAMILIES}, c AS (SELECT hash, min('v' || (100000 + vec_id)) AS rep FROM f GROUP BY hash) SELECT a.rep AS a, b.rep AS b FROM c a JOIN c b ON a.rep < b.rep AND bit_count(xor(a.hash, b.hash)) <= 12")
def near_pairs_legacy(spark, sf_dir):
    return dedupe.near_pairs(dedupe.fingerprint_classes(_families(spark, sf_dir)), C.NEAR_BITS_CLASSIC)


def _kept_in_turn(most: int, bits: int) -> str:
    """DuckDB: each site's images one after the other; the state is a list of those kept."""
    return f"""
WITH RECURSIVE {_INT_HASH}, {_FAMILIES},
m AS (SELECT label::VARCHAR AS site, 'v' || (100000 + vec_id) AS url, hash, (vec_id * 7 % 97 + 900)::BIGINT * 900 AS area, row_number() OVER (PARTITION BY label ORDER BY 'v' || (100000 + vec_id)) AS i FROM f),
walk(site, i, kept) AS (
  SELECT DISTINCT site, 0::BIGINT, list_filter([{{'hash': 0::BIGINT, 'area': 0::BIGINT, 'url': '', 'replaced': 0::INT}}], lambda x: x.url <> '') FROM m
  UNION ALL
  SELECT site, i, CASE WHEN len(kept) >= {most} THEN kept
      WHEN coalesce(hit, 0) = 0 THEN list_append(kept, {{'hash': hash, 'area': area, 'url': url, 'replaced': 0::INT}})
      WHEN area > kept[hit].area THEN list_transform(kept, lambda x, j: CASE WHEN j = hit THEN {{'hash': hash, 'area': area, 'url': url, 'replaced': (x.replaced + 1)::INT}} ELSE x END) ELSE kept END
  FROM (SELECT m.*, walk.kept, list_position(list_transform(walk.kept, lambda x: bit_count(xor(x.hash, m.hash)) <= {bits}), true) AS hit FROM walk JOIN m ON m.site = walk.site AND m.i = walk.i + 1)),
last AS (SELECT site, arg_max(kept, i) AS kept FROM walk GROUP BY site)
SELECT site, k.url AS asset_url, k.replaced AS replaced FROM (SELECT site, unnest(kept) AS k FROM last)"""


@_query(_kept_in_turn(40, 8))
def greedy_dedupe(spark, sf_dir):
    return dedupe.greedy_dedupe(_families(spark, sf_dir), most=40)


@_query(_kept_in_turn(40, 12))
def greedy_dedupe_legacy(spark, sf_dir):
    return dedupe.greedy_dedupe(_families(spark, sf_dir), most=40, bits=C.NEAR_BITS_CLASSIC)


# ---- crawling and jobs ----


def _first_in_first_out(starts: str, most: int) -> str:
    """DuckDB: each site's queue of pages, one page taken from it in a step; the first ``most`` of the queue are visited."""
    return f"""
WITH RECURSIVE adj AS (SELECT src, list(dst ORDER BY pos) AS kids FROM <edges> GROUP BY src),
walk(site, i, pages, depths) AS (
  SELECT site, 0::BIGINT, [page], [0] FROM (VALUES {starts}) AS st(site, page)
  UNION ALL
  SELECT site, i + 1, list_concat(pages, fresh), list_concat(depths, list_transform(fresh, lambda x: depths[i + 1] + 1)) FROM (
    SELECT walk.*, list_filter(coalesce(kids, []), lambda x, j: NOT list_contains(pages, x) AND list_position(kids, x) = j) AS fresh
    FROM walk LEFT JOIN adj ON src = pages[i + 1] WHERE i < least(len(pages), {most}))),
last AS (SELECT site, arg_max(pages, i)[1:{most}] AS pages, arg_max(depths, i)[1:{most}] AS depths FROM walk GROUP BY site),
v AS (SELECT site, unnest(pages) AS page, unnest(depths) AS depth, generate_subscripts(pages, 1) - 1 AS visit_rank FROM last)"""


@_query(_first_in_first_out("('s', 0::BIGINT)", 1_000_000) + " SELECT page, depth::INT AS depth FROM v")
def crawl_levels(spark, sf_dir):
    start = spark.createDataFrame([("s", 0)], "site string, page long")
    return crawl.crawl(derived(spark, sf_dir, "edges"), start, most=1_000_000).select("page", "depth")


@_query(_first_in_first_out("('s', 0::BIGINT), ('t', 5::BIGINT)", 100) + " SELECT site, page, depth::INT AS depth, visit_rank::BIGINT AS visit_rank FROM v")
def crawl_capped(spark, sf_dir):
    start = spark.createDataFrame([("s", 0), ("t", 5)], "site string, page long")
    return crawl.crawl(derived(spark, sf_dir, "edges"), start)


@_query("""
WITH s AS (SELECT DISTINCT dst AS page FROM <edges> WHERE src = 0 AND dst <> 0 ORDER BY page LIMIT 39) SELECT 's' AS site, 0::BIGINT AS page UNION ALL SELECT 's', page FROM s""")
def crawl_start_page(spark, sf_dir):
    return crawl.crawl_classic(derived(spark, sf_dir, "edges"), spark.createDataFrame([("s", 0)], "site string, page long"))


@_query("SELECT DISTINCT dst AS url FROM <edges> WHERE dst % 3 <> 0 AND dst % 5 <> 0")
def unvisited_links(spark, sf_dir):
    links = derived(spark, sf_dir, "edges").select(F.col("dst").alias("url"))
    return crawl.unvisited(links, links.where("url % 3 = 0").distinct(), links.where("url % 5 = 0").distinct())


@_query("""
WITH f AS (SELECT url, min((NOT is_current)::INT * 1000000000000 + pos) AS k FROM <jobs> GROUP BY url) SELECT row_number() OVER (ORDER BY k)::INT AS position, url FROM f""")
def restored_queue(spark, sf_dir):
    return jobs.restore(derived(spark, sf_dir, "jobs"))


@_query("""
WITH q AS (SELECT o_orderkey AS url, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders), m AS (SELECT max(url) AS moved, min(url) FILTER (position = 7) AS target FROM q)
SELECT row_number() OVER (ORDER BY CASE WHEN url = moved THEN 6.5 ELSE position END)::INT AS position, 'u' || url AS url FROM q CROSS JOIN m""")
def reordered_queue(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), "o_orderkey")
    queue = jobs.positions(rows, "o_orderkey")
    last = queue.agg(F.max_by("url", "position").alias("m"), F.min_by("url", F.abs(F.col("position") - 7)).alias("t")).first()
    return jobs.move_before(queue.select("position", "url"), last.m, last.t)


@_query("SELECT min_by(url, pos) AS url FROM <jobs> WHERE url <> 'https://u1.example.com'")
def next_job(spark, sf_dir):
    return jobs.next_job(jobs.remove(derived(spark, sf_dir, "jobs").withColumnRenamed("pos", "position"), "https://u1.example.com"))


@_query("SELECT event_id AS seq, event_type AS line FROM events ORDER BY event_id DESC LIMIT 12")
def log_tail(spark, sf_dir):
    return jobs.log_tail(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("line")), shown=C.LOG_SHOWN)


@_query("""
SELECT CASE WHEN trim(value) LIKE 'http%' THEN trim(value) ELSE 'https://' || trim(value) END AS url FROM <batch> WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%'""")
def batch_urls(spark, sf_dir):
    return batch_lines(derived(spark, sf_dir, "batch"))


# ---- the whole ----


@_query(r"""
WITH p AS (SELECT site, url, regexp_extract(html, 'src="/i/(\d+)', 1)::INT AS k FROM <rich_pages>),
a AS (SELECT DISTINCT site, unnest([site || 'i/' || k || '.jpg', site || 'l/' || k || '.png', site || 'a' || (k % 7) || '.jpg?v=1', site || 'p' || k || '.jpg', site || 'work/clip' || (k % 3) || '.mp4',
  'https://cdn.sanity.io/images/p/d/' || (k % 5) || '.jpg', 'https://cdn.sanity.io/images/abc1/prod/a' || (k % 4) || '.jpg']) AS u FROM p)
SELECT site, 'S' || substr(string_split(string_split(site, '/')[3], '.')[1], 2) AS studio, 'Standard' AS platform, (SELECT count(*) FROM p WHERE p.site = a.site) AS pages, count(*) AS candidates,
  count(*) FILTER (u LIKE '%.mp4') AS videos FROM a GROUP BY site""")
def site_summary(spark, sf_dir):
    return summary.site_summary(derived(spark, sf_dir, "rich_pages"))


@_query(r"""
WITH p AS (SELECT site, url, visit_rank, regexp_extract(html, 'src="/i/(\d+)', 1)::INT AS k FROM <rich_pages>),
a AS (SELECT site, url, visit_rank, unnest([{'u': site || 'i/' || k || '.jpg', 'k': site || 'i/' || k || '.jpg?', 's': 0}, {'u': site || 'l/' || k || '.png', 'k': site || 'l/' || k || '.png?', 's': 0},
  {'u': site || 'a' || (k % 7) || '.jpg?w=900&v=1', 'k': site || 'a' || (k % 7) || '.jpg?v=1', 's': 810000}, {'u': site || 'p' || k || '.jpg', 'k': site || 'p' || k || '.jpg?', 's': 0},
  {'u': site || 'work/clip' || (k % 3) || '.mp4', 'k': site || 'work/clip' || (k % 3) || '.mp4?', 's': 0}, {'u': 'https://cdn.sanity.io/images/p/d/' || (k % 5) || '-10x10.jpg', 'k': 'https://cdn.sanity.io/images/p/d/' || (k % 5) || '.jpg?', 's': 100},
  {'u': 'https://cdn.sanity.io/images/abc1/prod/a' || (k % 4) || '-100x200.jpg', 'k': 'https://cdn.sanity.io/images/abc1/prod/a' || (k % 4) || '.jpg?', 's': 20000}]) AS x FROM p)
SELECT site, x.k AS asset_key, x.u AS asset_url, x.s::BIGINT AS score, url AS page_url FROM a QUALIFY row_number() OVER (PARTITION BY site, x.k ORDER BY length(url) DESC, visit_rank, url) = 1""")
def site_assets(spark, sf_dir):
    return summary.assets_of_sites(derived(spark, sf_dir, "rich_pages"))
