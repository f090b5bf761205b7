"""Hand-made cases and plain reference loops for the core's operators."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sitelattice import sources, streaming
from sitelattice.functions import constants as C
from sitelattice.functions import fingerprints, http, names, urls
from sitelattice.operators import crawl, dedupe, extract, jobs, select, summary
from sitelattice.plans import inputs

ONES = (1 << 63) - 1


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("https://static.wixstatic.com/media/ab_c~mv2.jpg/v1/fill/w_640,h_480/x.jpg", "https://static.wixstatic.com/media/ab_c~mv2.jpg"),
    ("https://static.wixstatic.com/media/abc.png/v1/fit/q.png", "https://static.wixstatic.com/media/abc.png"),
    ("https://static.wixstatic.com/media/abc.png?x=1", "https://static.wixstatic.com/media/abc.png?x=1"),
])
def test_wix(spark, raw, want):
    assert one(spark, urls.wix_original("u"), u=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("https://s.com/wp-content/uploads/2024/05/cat-300x200.jpg", "https://s.com/wp-content/uploads/2024/05/cat.jpg"),
    ("https://s.com/wp-content/uploads/2024/05/cat-300x200.jpg?v=1", "https://s.com/wp-content/uploads/2024/05/cat-300x200.jpg?v=1"),
    ("https://s.com/wp-content/uploads/cat-300x200.jpg", "https://s.com/wp-content/uploads/cat-300x200.jpg"),
])
def test_uploads(spark, raw, want):
    assert one(spark, urls.wordpress_original("u"), u=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("https://c.com/a.jpg?w=400&v=2", "https://c.com/a.jpg?v=2"),
    ("https://C.com:8080/a.jpg?w=1200&v=2#f", "https://c.com/a.jpg?v=2"),
    ("https://freight.cargo.site/w/1000/i/abc/p.jpg", "https://freight.cargo.site/i/abc/p.jpg?"),
    ("https://freight.cargo.site/t/original/i/abc/p.jpg", "https://freight.cargo.site/i/abc/p.jpg?"),
    ("https://c.com/img/w_500,h_300/b.jpg", "https://c.com/img/b.jpg?"),
    ("https://c.com/u/a-w200-x.jpg", "https://c.com/u/a-x.jpg?"),
])
def test_canonical_key(spark, raw, want):
    assert one(spark, urls.canonical_key("u"), u=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("https://c.com/a.jpg?w=400&v=2", 160000), ("https://c.com/a.jpg?w=400&h=300", 120000), ("https://c.com/w_500,h_300/b.jpg", 150000), ("https://c.com/a-1024x768.jpg", 786432),
    ("https://c.com/h600/a.jpg", 360000), ("https://c.com/a.jpg", 0), ("https://c.com/a-1024x768.jpg?w=100", 786432), ("https://c.com/a.jpg?w=9000000000000000000&h=9000000000000000000", (1 << 63) // 8 - 1),
    ("https://freight.cargo.site/t/original/i/a/b.jpg", ((1 << 63) - 1) // 4),
])
def test_resolution_score(spark, raw, want):
    assert one(spark, urls.resolution_score("u"), u=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("a &amp; b", "a & b"), ("&#65;&#x42;&#8364;&#x1F600;", "AB€😀"), ("&lt;p&gt; &quot;q&quot;", '<p> "q"'), ("no entity", "no entity"), ("&amp;lt;", "&lt;"),
])
def test_entities(spark, raw, want):
    assert one(spark, urls.decode_entities("u"), u=raw) == want


@pytest.mark.parametrize("ref, want", [
    ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"),
    ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("g;x=1/../y", "http://a/b/c/y"), ("mailto:x@y", "mailto:x@y"),
])
def test_resolve_as_in_the_standard(spark, ref, want):
    assert one(spark, urls.resolve("r", "b"), r=ref, b="http://a/b/c/d;p?q") == want


@pytest.mark.parametrize("raw, want", [("  a//b??c -- ", "a-b-c"), ("...", "file"), ("My  Photo: 50%", "My Photo- 50"), ("a - - b", "a - - b")])
def test_sanitize(spark, raw, want):
    assert one(spark, names.sanitize_base("n"), n=raw) == want


def test_filename_is_cut_and_composed(spark):
    got = one(spark, names.sanitize_filename("n", compose=True), n="é" + "x" * 200 + ".JPEG")
    assert got.startswith("éx") and got.endswith(".jpeg") and len(got) == C.MAX_FILENAME


@pytest.mark.parametrize("path, want", [("/{{x}}", -(1 << 61)), ("/feed", -100), ("/a.css", -200), ("/", 0), ("/work/x", 107), ("", 0)])
def test_referer_priority(spark, path, want):
    assert one(spark, urls.referer_priority("u"), u="https://s.com" + path) == want


def test_attributes(spark):
    html = "<img data-src=\"a.jpg\" SRC='b.jpg'><script src=\"c.js\"><img src=bare.jpg><img src=\"it's.jpg\">"
    assert one(spark, extract.attribute_values("h", "src"), h=html) == ["a.jpg", "b.jpg", "c.js", "it"]
    assert one(spark, extract.srcset_values("h", "srcset"), h='<img srcset=" /a.jpg 1x,  /b.jpg 2x">') == ["/a.jpg", "/b.jpg"]


def test_scans_are_off_unless_asked(spark):
    html = "<script>var v = 'https://a.com/v.mp4'</script>"
    assert one(spark, extract.raw_candidates("h"), h=html) == []
    assert one(spark, extract.raw_candidates("h", True), h=html) == ["https://a.com/v.mp4"]


def test_origin_is_a_prefix_unless_strict(spark):
    link = {"r": "https://a.com.evil.net/x", "s": "https://a.com/"}
    assert one(spark, urls.internal_link(F.col("r"), F.col("s"), F.col("s")), **link) == "https://a.com.evil.net/x"
    assert one(spark, urls.internal_link(F.col("r"), F.col("s"), F.col("s"), True), **link) is None


def test_channel_hash(spark):
    bits = lambda v: one(spark, fingerprints.channel_hash(F.array(*(F.lit(x) for x in v)))) & (1 << 64) - 1
    assert bits([5] * 64) == (1 << 64) - 1
    assert bits(range(64)) == 0xFFFFFFFF80000000
    assert bits([0] * 63 + [255]) == 1 << 63


def test_near(spark):
    def near(*d):
        left = {c: F.lit(0).cast("long") for c in "rgb"}
        return one(spark, fingerprints.is_near(left, {c: F.lit((1 << n) - 1).cast("long") for c, n in zip("rgb", d)}))

    assert near(8, 8, 8) and not near(9, 0, 0)


def image(url, bits, area, site="s"):
    mark = (1 << bits) - 1 if bits is not None else None
    return (site, url, mark, mark, mark, area, 1)


SCHEMA = "site string, asset_url string, r long, g long, b long, w int, h int"


@pytest.mark.parametrize("rows, most, want", [
    ([image("a", 0, 100), image("b", 8, 400), image("c", 16, 50)], 200, {"b"}),
    ([image("a", 16, 50), image("b", 0, 100), image("c", 8, 400)], 200, {"c", "b"}),
    ([image("a", 0, 100), image("b", 8, 400)], 1, {"a"}),
    ([image("a", None, 1), image("b", None, 1)], 200, {"a", "b"}),
])
def test_greedy(spark, rows, most, want):
    got = dedupe.greedy_dedupe(spark.createDataFrame(rows, SCHEMA), most).collect()
    assert {r.asset_url for r in got} == want


def test_greedy_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(3)}", f"u{i:03d}", *(rng.choice([0, 7, 255, 4095, ONES]) ^ 1 << rng.randrange(20) for _ in range(3)), rng.randrange(9), 3) for i in range(300)]
    want = set()
    for site in {r[0] for r in rows}:
        saved = []
        for r in sorted(x for x in rows if x[0] == site):
            if len(saved) >= 25:
                break
            for i, s in enumerate(saved):
                if all((a ^ b).bit_count() <= 8 for a, b in zip(r[2:5], s[2:5])):
                    if r[5] * r[6] > s[5] * s[6]:
                        saved[i] = r
                    break
            else:
                saved.append(r)
        want |= {(r[0], r[1]) for r in saved}
    got = dedupe.greedy_dedupe(spark.createDataFrame(rows, SCHEMA), 25).collect()
    assert {(r.site, r.asset_url) for r in got} == want


@pytest.mark.parametrize("given, want", [
    (["x.jpg", "x.jpg", "x.jpg", "x 2.jpg"], ["x.jpg", "x 2.jpg", "x 3.jpg", "x 2 2.jpg"]),
    (["a.jpg", "a.jpg", "a 2.jpg", "a 2.jpg"], ["a.jpg", "a 2.jpg", "a 2 2.jpg", "a 2 3.jpg"]),
    (["a 2.jpg", "a.jpg", "A.JPG", "a.jpg"], ["a 2.jpg", "a.jpg", "A 3.jpg", "a 4.jpg"]),
    (["b", "b", None, "b 2"], ["b", "b 2", None, "b 2 2"]),
    (["y" * 130 + ".png"] * 2, ["y" * 116 + ".png", "y" * 114 + " 2.png"]),
])
def test_unique_names(spark, given, want):
    rows = spark.createDataFrame([("d", n, f"u{i}") for i, n in enumerate(given)] + [("e", n, f"u{i}") for i, n in enumerate(given)], "folder string, name string, asset_url string")
    for folder in "de":
        assert [r.file_name for r in dedupe.unique_names(rows).where(F.col("folder") == folder).orderBy("asset_url").collect()] == want


def test_unique_names_by_the_classic_rule(spark):
    given = ["x.jpg", "x.jpg", "x_1.jpg", "X.jpg", ".hidden", ".hidden", "a.tar.gz", "a.tar.gz"]
    rows = spark.createDataFrame([("d", n, f"u{i}") for i, n in enumerate(given)], "folder string, name string, asset_url string")
    got = [r.file_name for r in dedupe.unique_names(rows, classic=True).orderBy("asset_url").collect()]
    assert got == ["x.jpg", "x_1.jpg", "x_1_1.jpg", "X.jpg", ".hidden", ".hidden_1", "a.tar.gz", "a.tar_1.gz"]


@pytest.mark.parametrize("bits", [8, 12])
def test_near_pairs_against_all_pairs(spark, bits):
    rng = random.Random(bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for i in range(120):
        base = [rng.choice([0, (1 << 64) - 1, rng.getrandbits(64)]) for _ in range(3)] if i % 4 == 0 else base
        rows.append((f"u{i:03d}", *(signed(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(bits)))) for x in base)))
    got = dedupe.near_pairs(spark.createDataFrame(rows, "rep string, r long, g long, b long"), bits).collect()
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and all(((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in zip(x[1:], y[1:]))}
    assert want and {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_near_pairs_are_not_sent_to_the_driver(spark):
    """However small the estimate of the fingerprints' size, their bands are joined by a shuffle."""
    rows = spark.createDataFrame([("a", 1, 1, 1), ("b", 3, 3, 3)], "rep string, r long, g long, b long")
    pairs = dedupe.near_pairs(rows)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bands_of_green_are_spread_over_those_of_red():
    for bits in (8, 12):
        red, green = dedupe._band_masks(bits), dedupe._band_masks(bits, strided=True)
        for masks in (red, green):
            assert sum(m % (1 << 64) for m in masks) == (1 << 64) - 1 and len(masks) == bits + 1
        assert max(((r & g) % (1 << 64)).bit_count() for r in red for g in green) == 1


@pytest.mark.parametrize("raw, want", [("\n/c.jpg\t", "https://a.com/c.jpg"), ("\u00a0 c.jpg\r\n", "https://a.com/x/c.jpg"), ("\tdata:image/png;base64,A", None), ("", None)])
def test_normalize_strips_white_space_and_line_ends(spark, raw, want):
    assert one(spark, urls.normalize("r", F.col("b")), r=raw, b="https://a.com/x/y.html") == want
    if raw:
        assert one(spark, urls.normalize("r", F.col("b"), classic=True), r=raw, b="https://a.com/x/y.html") == want


def test_classic_links_come_from_anchors(spark):
    html = "<base href='/z'><a class=k href='\n/work/x?y#z '>t</a><a href='#top'>u</a><a href='/About/us'>v</a><area href='/no'><a name='q'>w</a>"
    rows = spark.createDataFrame([("https://a.com/", html)], "url string, html string")
    assert [r.link for r in extract.classic_links(rows).collect()] == ["https://a.com/work/x"]


def test_rendered_pages_join_raw_ones(spark):
    raw = spark.createDataFrame([("https://a.com/", '<img src="/x.jpg">')], "url string, html string")
    seen = spark.createDataFrame([("https://a.com/", "", ["/y.jpg", "blob:z"], ["/p"])], "url string, html string, asset_candidates array<string>, link_candidates array<string>")
    rows = sources.both(raw, seen).withColumn("site_url", F.lit("https://a.com/"))
    assert {r.asset_url for r in extract.page_assets(rows).collect()} == {"https://a.com/x.jpg", "https://a.com/y.jpg"}
    assert [r.link for r in extract.page_links(rows).collect()] == ["https://a.com/p"]


def test_run_options():
    assert jobs.RunOptions().max_images == 200
    for bad in (0, 1001, 2.5, True):
        with pytest.raises(ValueError):
            jobs.RunOptions(max_images=bad)


def test_queue_is_stored_and_restored(spark, tmp_path):
    queue = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a")], "position int, url string")
    for current in (None, "a"):
        sources.write_queue(queue, str(tmp_path / "q"), current)
        got = jobs.restore(sources.read_queue(spark, str(tmp_path / "q"))).orderBy("position").collect()
        assert [r.url for r in got] == (["b", "c", "a"] if current is None else ["a", "b", "c"])


def test_variants_in_order(spark):
    rows = spark.createDataFrame([(f"https://c.com/{n}.jpg?w={w}",) for n in "cab" for w in (100, 300, 200)], "asset_url string")
    assert [r.asset_url for r in select.largest_variants(rows, ordered=True).collect()] == [f"https://c.com/{n}.jpg?w=300" for n in "abc"]


def test_crawl_is_breadth_first_and_capped(spark):
    rng = random.Random(1)
    links = [(a, rng.randrange(40), k) for a in range(40) for k in range(3)]
    order, seen, queue = [], {0}, [0]
    while queue and len(order) < 17:
        page = queue.pop(0)
        order.append(page)
        for _, dst, _ in sorted((x for x in links if x[0] == page), key=lambda x: x[2]):
            if dst not in seen:
                seen.add(dst)
                queue.append(dst)
    got = crawl.crawl(spark.createDataFrame(links, "src long, dst long, pos int"), spark.createDataFrame([("s", 0)], "site string, page long"), 17).orderBy("visit_rank").collect()
    assert [r.page for r in got] == order


def test_headers(spark):
    text = "HTTP/1.1 302 X\r\nA: 1\r\n\r\nHTTP/2 200\r\na:  2 \r\n\r\n"
    assert one(spark, http.last_status("h"), h=text) == 200
    assert one(spark, http.last_header("h", "A"), h=text) == "2"
    assert one(spark, http.last_header("h", "B"), h=text) is None


def test_body_decoding(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "c binary")
    assert [r.x for r in rows.select(http.decode_body("c").alias("x")).collect()] == ["é", "é"]


def test_small_images(spark):
    rows = spark.createDataFrame([(900, 1), (899, 899), (None, None)], "w int, h int")
    assert [r.x for r in rows.select(select.is_small(F.col("w"), F.col("h")).alias("x")).collect()] == [False, True, True]


def test_queue(spark):
    queue = spark.createDataFrame([(i, f"u{i}") for i in range(1, 6)], "position int, url string")
    moved = jobs.move_before(queue, "u5", "u2").orderBy("position")
    assert [r.url for r in moved.collect()] == ["u1", "u5", "u2", "u3", "u4"]
    assert jobs.next_job(jobs.remove(moved, "u1")).first().url == "u5"


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "site string, url string, html string, visit_rank long")
    assert summary.site_summary(pages).count() == 0
    assert dedupe.greedy_dedupe(spark.createDataFrame([], SCHEMA)).count() == 0
    assert jobs.positions(spark.createDataFrame([], "url string"), "url").count() == 0


def png(width, height, pixel):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "solid.png").write_bytes(png(16, 16, lambda x, y: (9, 9, 9)))
    (tmp_path / "ramp.png").write_bytes(png(16, 16, lambda x, y: (16 * y, 0, 255 - 16 * y)))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    got = {r.path.rsplit("/", 1)[1]: r for r in sources.images(spark, str(tmp_path)).collect()}
    assert (got["solid.png"].w, got["solid.png"].r, got["solid.png"].b) == (16, -1, -1)
    assert got["ramp.png"].r & (1 << 64) - 1 == 0xFFFFFFFF00000000 and got["ramp.png"].b == 0xFFFFFFFF
    assert got["broken.png"].w is None and got["broken.png"].r is None


def test_media_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "x.jpg", bytearray(b"1")), ("a", "empty.jpg", bytearray(b""))], "folder string, file_name string, content binary")
    sources.write_media(rows, str(tmp_path / "table"))
    assert [r.path for r in spark.read.parquet(str(tmp_path / "table")).collect()] == ["a/b/x.jpg"]
    sources.export_media(rows, str(tmp_path / "files"))
    assert (tmp_path / "files/a/b/x.jpg").read_bytes() == b"1"


def test_batch_file(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# c\n\n a.com \nhttp://b.com\n")
    assert [r.url for r in sources.batch_urls(spark, str(tmp_path / "b.txt")).collect()] == ["https://a.com", "http://b.com"]


def test_stream_of_pages(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.com/", '<img src="/x.jpg"><img src="/x.jpg">')], streaming.PAGE_SCHEMA).write.parquet(str(tmp_path / "in"))
    rows = streaming.page_assets(streaming.read_pages(spark, str(tmp_path / "in")))
    query = rows.writeStream.format("memory").queryName("found_assets").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("found_assets").collect()] == [("https://a.com/", "https://a.com/x.jpg")]


def test_stream_of_jobs_takes_each_once(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs/1.json").write_text('{"pos": 1, "url": "a"}\n{"pos": 2, "url": "a"}\n')
    for _ in range(2):
        streaming.start(streaming.new_jobs(streaming.read_jobs(spark, str(tmp_path / "jobs"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_late_events_are_left_out(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    line = '{{"ts": "2024-01-01T00:{:02d}:00Z", "site": "s", "kind": "saved", "message": ""}}\n'
    (tmp_path / "ev/1.json").write_text(line.format(0) + line.format(0) + line.format(30))
    rows = streaming.progress(streaming.read_events(spark, str(tmp_path / "ev")))
    query = rows.writeStream.format("memory").queryName("minutes").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("minutes").collect()] == [2]


def test_long_queues_are_numbered_without_gaps(spark):
    """Of more rows than the bounds of ranges are drawn from; some of them long, which only one use of the rows reads."""
    n = 200_000
    rows = spark.range(0, n, 1, 8).select(F.concat(F.lit("u"), F.hash("id").cast("string"), F.lit("-"), "id").alias("url"), F.xxhash64("id").alias("k"))
    got = jobs.positions(rows, "k").agg(F.count("*"), F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(got) == (n, 1, n, n)
    queue = jobs.positions(rows, "k").select("position", "url")
    first, last = (queue.where(F.col("position") == i).first().url for i in (7, n))
    moved = jobs.move_before(queue, last, first)
    assert moved.where("position BETWEEN 6 AND 8").orderBy("position").collect()[1].url == last
    assert moved.select("position").distinct().count() == n


@pytest.mark.parametrize("carry", [False, True])
def test_assets_of_sites_need_no_join(spark, carry):
    """As from the steps one by one; an upload may be the upgrade of another and be upgraded itself."""
    up = "https://s.com/wp-content/uploads/2024/05/"
    pages = spark.createDataFrame([
        ("https://s.com/", "https://s.com/a", f"<img src='{up}x-10x10-20x20.jpg'><img src='/c.jpg?w=10'>", 2),
        ("https://s.com/", "https://s.com/b/c", f"<img src='{up}x-10x10.jpg'><img src='{up}y-30x30.jpg'><img src='/c.jpg?w=20'>", 1),
        ("https://s.com/", "https://s.com/d", f"<img src='{up}y.jpg'><img src='/c.jpg?w=20'>", 0),
        ("https://s.com/", "https://s.com/d", f"<img src='{up}y.jpg'>", 0),
        ("https://t.com/", "https://t.com/", f"<img src='{up}y-30x30.jpg'>", 0),
    ], "site string, url string, html string, visit_rank int")
    got = summary.assets_of_sites(pages, carry_referer=carry)
    found = extract.page_assets(pages, keep=("site", "visit_rank")).withColumnRenamed("url", "page_url")
    assets = select.upgrade_uploads(found.select("site", "asset_url").distinct(), select.best_referer(found, ("site",)), ("site",), carry)
    want = select.largest_variants(assets, ("site",)).join(assets, ["site", "asset_url"], "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in summary.site_summary(pages, carry_referer=carry)._jdf.queryExecution().executedPlan().toString()


def test_slug_links_are_joined_by_slug(spark):
    """Not once for each template; the first template that answers counts, under the page's own address."""
    found = '<script>self.__next_f.push({"slug":"one-1"},{"slug":"two"},{"slug":"three"})</script>'
    pages = spark.createDataFrame([("https://a.com/x/?q", found), ("https://a.com", found), ("https://a.com", found)], "url string, html string")
    answers = [("https://a.com/x/portfolio/one-1", 200), ("https://a.com/x/works/one-1", 200), ("https://a.com/x/work/one-1", 404), ("https://a.com/work/two", 200), ("https://a.com/work/two", 200),
               ("https://a.com/y/work/two", 200), ("https://a.com/x/homework/three", 200), ("https://a.com/x/work/three/", 200), ("https://a.com/work/work/one-1", 200), (None, 200)]
    links = extract.slug_links(pages, spark.createDataFrame(answers, "url string, status int"))
    assert sorted(map(tuple, links.collect())) == [("https://a.com", "two", "https://a.com/work/two"), ("https://a.com/x/?q", "one-1", "https://a.com/x/works/one-1")]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "posexplode" not in plan


@pytest.mark.parametrize("name", inputs.PAGES)
def test_pages_are_made_by_many_tasks(spark, tmp_path, name):
    """However few bytes of a table they come from."""
    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = inputs.derived(spark, str(tmp_path), name)
    in_task = [r.n for r in pages.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(in_task) >= 3 and sum(in_task) == 50_000 and max(in_task) < 20_000
