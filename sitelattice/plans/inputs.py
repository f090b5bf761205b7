"""Deterministic inputs derived from the test tables.

Each is one SELECT in the SQL that Spark and DuckDB share, with tables in
braces, so the queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

INPUTS = {
    # pages with their site and a visit order
    "site_pages": r"""
        SELECT page_id, url, html, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) || '/' AS site_url, page_id AS visit_rank FROM {pages}""",
    # pages with assets of every kind
    "rich_pages": r"""
        SELECT p_partkey AS page_id, p_partkey AS visit_rank, 'https://s' || CAST(p_partkey % 20 AS STRING) || '.example.com/' AS site,
               'https://s' || CAST(p_partkey % 20 AS STRING) || '.example.com/work/p' || CAST(p_partkey AS STRING) AS url,
               '<img src="/i/' || CAST(p_partkey AS STRING) || '.jpg" data-src=' || chr(39) || '../l/' || CAST(p_partkey AS STRING) || '.png' || chr(39) ||
               ' srcset="/a' || CAST(p_partkey % 7 AS STRING) || '.jpg?w=100&amp;v=1 1x, /a' || CAST(p_partkey % 7 AS STRING) || '.jpg?w=900&amp;v=1 2x"><video poster="/p' || CAST(p_partkey AS STRING) ||
               '.jpg"></video><source src="clip' || CAST(p_partkey % 3 AS STRING) || '.mp4"><div style="background:url(https://cdn.sanity.io/images/p/d/' ||
               CAST(p_partkey % 5 AS STRING) || '-10x10.jpg?w=200)"></div><script>{{"projectId":"abc1","dataset":"prod","r":"image-a' || CAST(p_partkey % 4 AS STRING) ||
               '-100x200-jpg"}}; self.__next_f.push({{"slug":"proj-' || CAST(p_partkey % 9 AS STRING) || '"}}, {{"slug":"about"}}) "version":"Cargo2" "project_url":"work' || chr(92) || '/c' || CAST(p_partkey % 6 AS STRING) ||
               '" https://static.wixstatic.com/media/ab' || CAST(p_partkey % 4 AS STRING) || '~mv2.jpg/v1/fill/w_640/x.jpg "</script><a href="/about#top">a</a><a href="/work/n' ||
               CAST(p_partkey % 11 AS STRING) || '?x=1">n</a><a href="x.pdf">f</a><a href="mailto:a@b.c">m</a>' AS html
        FROM {part}""",
    "raw_urls": r"""
        SELECT p_partkey AS id, 'https://s' || CAST(p_partkey % 20 AS STRING) || '.example.com/a/b/c.html' AS base,
               CASE p_partkey % 12 WHEN 0 THEN '/img/' || CAST(p_partkey AS STRING) || '.jpg' WHEN 1 THEN '//cdn.example.com/x' || CAST(p_partkey AS STRING) || '.png'
                 WHEN 2 THEN chr(10) || 'data:image/png;base64,AAAA' WHEN 3 THEN chr(9) || ' ../up' || CAST(p_partkey AS STRING) || '.gif ' || chr(13) || chr(10) WHEN 4 THEN './same.webp'
                 WHEN 5 THEN 'https://cdn.sanity.io/images/p/d/' || CAST(p_partkey AS STRING) || '.jpg?w=10&h=20' WHEN 6 THEN 'JavaScript:void(0)'
                 WHEN 7 THEN 'https://static.wixstatic.com/media/ab_' || CAST(p_partkey AS STRING) || '~mv2.jpg/v1/fill/w_640,h_480/x.jpg'
                 WHEN 8 THEN '/_next/image?url=%2Fmedia%2Fpic' || CAST(p_partkey AS STRING) || '.jpg&w=640&q=75' WHEN 9 THEN 'page.jpg?a=1&amp;b=' || CAST(p_partkey AS STRING)
                 WHEN 10 THEN '' ELSE '?only=' || CAST(p_partkey AS STRING) END AS raw
        FROM {part}""",
    "variants": r"""
        SELECT 'https://cdn.example.com/img/' || CAST(l_partkey AS STRING) || '.jpg?w=' || CAST(CAST(floor(l_quantity * 20) AS INT) AS STRING) || '&v=1' AS asset_url FROM {lineitem}""",
    "odd_variants": r"""
        SELECT CASE p_partkey % 8
                 WHEN 0 THEN 'https://c.com/img/w_' || CAST(p_size * 10 + 100 AS STRING) || ',h_' || CAST(p_size * 5 + 50 AS STRING) || '/b' || CAST(p_partkey % 50 AS STRING) || '.jpg'
                 WHEN 1 THEN 'https://c.com/u/a' || CAST(p_partkey % 50 AS STRING) || '-' || CAST(p_size * 20 + 100 AS STRING) || 'x' || CAST(p_size * 10 + 100 AS STRING) || '.jpg'
                 WHEN 2 THEN 'https://freight.cargo.site/w/' || CAST(p_size * 100 AS STRING) || '/i/id' || CAST(p_partkey % 50 AS STRING) || '/p.jpg'
                 WHEN 3 THEN 'https://freight.cargo.site/t/original/i/id' || CAST(p_partkey % 50 AS STRING) || '/p.jpg'
                 WHEN 4 THEN 'https://c.com/u/w200/h100/b' || CAST(p_partkey % 50 AS STRING) || '.png'
                 WHEN 5 THEN 'https://C.com/x.jpg?height=' || CAST(p_size AS STRING) || '&z=2&a=' || CAST(p_partkey % 50 AS STRING) || '#f'
                 WHEN 6 THEN 'https://c.com/h' || CAST(p_size + 10 AS STRING) || '/a' || CAST(p_partkey % 50 AS STRING) || '.jpg'
                 ELSE 'https://c.com/plain' || CAST(p_partkey % 50 AS STRING) || '.jpg' END AS asset_url FROM {part}""",
    "uploads": r"""
        SELECT 'https://s' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) % 20 AS STRING) || '.example.com/wp-content/uploads/2024/05/p' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) || '-' ||
               CAST(p_size * 10 + 100 AS STRING) || 'x' || CAST(p_size * 5 + 50 AS STRING) || '.jpg' AS asset_url FROM {part}""",
    "edges": r"""
        SELECT page_id AS src, (page_id * 7 + k * 13 + 1) % (SELECT count(*) FROM {pages}) AS dst, CAST(k AS INT) AS pos
        FROM {pages} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS t""",
    "images": r"""
        SELECT 'site' || CAST(p_partkey % 20 AS STRING) AS site,
               'https://i.example.com/' || CAST(p_partkey AS STRING) || CASE p_partkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.webm' ELSE '' END AS asset_url,
               p_size * 40 AS w, p_size * 30 AS h, CAST(p_size AS BIGINT) * 2 * 1024 * 1024 AS declared_len, CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 1000 END AS len
        FROM {part}""",
    "jobs": r"""
        SELECT event_id AS pos, 'https://u' || CAST(user_id AS STRING) || '.example.com' AS url, event_id = (SELECT max(event_id) FROM {events}) AS is_current FROM {events}""",
    "candidates": r"""
        SELECT 'https://a.example.com/' || CAST(l_partkey % 300 AS STRING) || '.jpg' AS asset_url, l_orderkey AS visit_rank,
               'https://s.example.com' || CASE l_orderkey % 7 WHEN 0 THEN '/' WHEN 1 THEN '/feed' WHEN 2 THEN '/a.css' WHEN 3 THEN '/work/' || CAST(l_suppkey AS STRING) WHEN 4 THEN '/{{{{x}}}}' WHEN 5 THEN '' ELSE '/p' END AS page_url
        FROM {lineitem}""",
    "headers": r"""
        SELECT o_orderkey AS id, 'HTTP/1.1 302 Found' || chr(13) || chr(10) || 'Location: /x' || chr(13) || chr(10) || 'content-type: text/plain' || chr(13) || chr(10) || chr(13) || chr(10) ||
               'HTTP/2 ' || CAST(200 + o_orderkey % 250 AS STRING) || chr(13) || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Content-Type:  image/' || lower(o_orderstatus) || ' ' || chr(13) || chr(10) END || chr(13) || chr(10) AS headers
        FROM {orders}""",
    "attempts": r"""
        SELECT 'https://a.example.com/' || CAST(l_orderkey AS STRING) AS asset_url, l_linenumber AS attempt, CASE l_linenumber WHEN 1 THEN 'direct' WHEN 2 THEN 'tool' ELSE 'page' END AS via,
               CASE WHEN l_partkey % 3 = 0 THEN 403 WHEN l_partkey % 3 = 1 THEN 500 ELSE 200 END AS status, l_returnflag AS content, 'image/png' AS mime FROM {lineitem}""",
    "names": r"""
        SELECT p_partkey AS id, '  ' || replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN '//' WHEN 1 THEN ' ? ' WHEN 2 THEN ' -- ' ELSE '  ' END) || CASE p_partkey % 3 WHEN 0 THEN ': 50%' WHEN 1 THEN '... ' ELSE '' END AS name FROM {part}""",
    # names that are used again, and names that look like the numbered ones of others
    "files": r"""
        SELECT 'd' || CAST(p_partkey % 10 AS STRING) AS folder, CASE WHEN p_partkey % 3 = 0 THEN 'pic ' ELSE 'Pic ' END || CAST(p_size % 8 AS STRING) ||
               CASE CAST(floor(p_partkey / 10) AS BIGINT) % 4 WHEN 1 THEN ' 2' WHEN 2 THEN ' 3' ELSE '' END || '.JPG' AS name, 'u' || CAST(p_partkey + 100000 AS STRING) AS asset_url FROM {part}""",
    "downloads": r"""
        SELECT 'site' || CAST(p_partkey % 20 AS STRING) AS site, 'https://i.example.com/' || CASE WHEN p_partkey % 9 = 8 THEN 'logo' ELSE 'f' END || CAST(p_partkey + 100000 AS STRING) ||
               CASE p_partkey % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.webm' WHEN 4 THEN '' WHEN 5 THEN '.bmp' ELSE '.gif' END AS asset_url,
               p_size * 40 AS w, p_size * 30 AS h, CAST(p_size AS BIGINT) * 2 * 1024 * 1024 AS declared_len, CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(p_size AS BIGINT) * 1000 END AS len
        FROM {part}""",
    # pages with what a browser saw
    "rendered_pages": r"""
        SELECT p_partkey AS page_id, 'https://r' || CAST(p_partkey % 20 AS STRING) || '.example.com/' AS site_url, 'https://r' || CAST(p_partkey % 20 AS STRING) || '.example.com/w/' || CAST(p_partkey AS STRING) AS url,
               '<img src="/i/' || CAST(p_partkey AS STRING) || '.jpg"><a href="/n' || CAST(p_partkey % 7 AS STRING) || '">n</a>' AS html,
               split('https://r' || CAST(p_partkey % 20 AS STRING) || '.example.com/i/' || CAST(p_partkey AS STRING) || '.jpg~' || chr(10) || ' /bg' || CAST(p_partkey % 5 AS STRING) || '.png?x=1 ~data:image/png;base64,AA', '~') AS asset_candidates,
               split('https://r' || CAST(p_partkey % 20 AS STRING) || '.example.com/deep/' || CAST(p_partkey % 3 AS STRING) || '#f~https://other.example.org/x', '~') AS link_candidates
        FROM {part}""",
    # pages with more project slugs than a run follows
    "slug_pages": r"""
        SELECT p_partkey AS page_id, 'https://n' || CAST(p_partkey AS STRING) || '.example.com/w' AS url, '<script>self.__next_f.push({{"slug":"about"}},{{"slug":"ab"}},"""
    + ",".join(f'{{{{"slug":"s-{i:02d}"}}}}' for i in range(30))
    + r""")</script>' AS html FROM {part}""",
    "cargo_pages": r"""
        SELECT p_partkey AS page_id, 'https://c' || CAST(p_partkey AS STRING) || '.example.com/a' AS url,
               '<script type="text/json" data-set="x">{{"pages":[{{"project_url":"p' || CAST(p_partkey % 5 AS STRING) || '","display":true}},{{"project_url":"hidden","display":false}},{{"project_url":"q' || CAST(p_partkey % 3 AS STRING) ||
               '"}}]}}</script><script type="text/json" data-set="y"> [{{"url":"thumb' || CAST(p_partkey % 4 AS STRING) || '"}},{{"url":""}}]</script><script type="text/json">{{"i":"https://freight.cargo.site/t/original/i/z' || CAST(p_partkey AS STRING) ||
               '/q.PNG"}}</script><img alt="" src="https://freight.cargo.site/w/100/i/y' || CAST(p_partkey % 6 AS STRING) || '/a.jpg"><img data-src="https://freight.cargo.site/w/1/i/x.svg"><div data-src="//cdn.example.com/freight.jpg"></div><img src="/own.jpg">' AS html
        FROM {part}""",
    "batch": r"""
        SELECT CASE c_custkey % 5 WHEN 0 THEN '# comment ' || c_name WHEN 1 THEN '' WHEN 2 THEN '  http://' || c_name || '.com ' WHEN 3 THEN c_name || '.com/x' ELSE '   ' END AS value FROM {customer}""",
}


def names_in(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


#: Inputs whose pages are made of a few bytes of a row, and so many rows at most that one task turns into pages.
PAGES, PAGES_IN_TASK = ("rich_pages", "rendered_pages", "slug_pages", "cargo_pages"), 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` to tasks of ``PAGES_IN_TASK`` rows or so, and to every core at least.

    A file of a few MB is one task to Spark, whatever its rows grow to.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PAGES_IN_TASK)), key)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = INPUTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names_in(text)}
    if name in PAGES:
        tables["part"] = spread(tables["part"], "p_partkey")
    return spark.sql(text, **tables)


def sql(text: str) -> str:
    """DuckDB SQL in which ``<input>`` stands for a derived input."""
    used = [n for n in INPUTS if f"<{n}>" in text]
    for n in used:
        text = text.replace(f"<{n}>", f"in_{n}")
    parts = [f"in_{n} AS ({INPUTS[n].format(**{t: t for t in names_in(INPUTS[n])}).strip()})" for n in used]
    head = "WITH RECURSIVE " if "RECURSIVE" in text else "WITH "
    text = text.strip()
    rest = re.sub(r"^WITH (RECURSIVE )?", "", text) if text.startswith("WITH") else None
    return head + ",\n".join(parts) + (",\n" + rest if rest else "\n" + text) if parts else text
