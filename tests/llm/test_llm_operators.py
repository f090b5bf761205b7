"""Each training-data operator against a plain version, and on the odd cases that it defines."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelattice.llm import decontaminate, exact_dedup, language_id, language_model, minhash, mixing, quality, sharding, substrings, textvec, toxicity
from sitelattice.llm.runtime import Scratch, components, in_one_task

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def words_of(text):
    return (text or "").encode().lower().split()


def text_of(rng, n, vocabulary=2000):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}x" for _ in range(n))


def prose(rng, n):
    """Text with some forty per cent of function words, the others from a large vocabulary."""
    return " ".join(f"f{int(rng.paretovariate(1)) % 60}" if rng.random() < 0.4 else f"content{rng.randrange(30_000)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, one word, a very long text, repeats, ties, and extra columns with clashing names."""
    rng = random.Random(9)
    same = text_of(rng, 80)
    texts = [None, "", " \t\n", "word", "Word", same, same, same.upper(), text_of(rng, 60_000), "é ß 漢字 😀", "!!! ???", same + " tail"] + [text_of(rng, 40) for _ in range(12)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", 0.5, 1, "x", i) for i, t in enumerate(texts)]
    rows += [(None, same, "en", "src1", 0.5, 1, "x", 0), (3, "word", "en", "src0", 0.5, 1, "x", 3)]
    return spark.createDataFrame(rows, DOCS + ", score double, label int, key string, rep long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_grams():
    found = textvec.words(pa.array(["Ab c\x0bd", None, "", "x", "É\xa0a b", "a" * 23 + " " + "a" * 24]))
    assert [found.word(i) for i in range(len(found.start))] == [b"ab", b"c", b"d", b"x", "É\xa0a".encode(), b"b", b"a" * 23, b"a" * 24]
    assert found.first.tolist() == [0, 3, 3, 3, 4, 6, 8]
    assert len(set(found.hash.tolist())) == 8
    _, start = found.grams(2)
    assert start.tolist() == [0, 1, 4, 6]
    value, first = textvec.char_grams(np.frombuffer(b"abcabc", np.uint8), np.array([0, 3, 6]), 3)
    assert first.tolist() == [0, 1, 2] and value[0] == value[1]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if find(x) != x}
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {r.node: r.component for r in components(frame, Scratch(spark, "test")).collect()} == want
    assert components(frame.where("a < 0"), Scratch(spark, "test")).count() == 0


# ---- classifiers ----


@pytest.mark.parametrize("operator, target, least", [(quality.op4, "quality", 0.9), (toxicity.op1, "toxic", 0.8)])
def test_classifiers_on_held_out_rows(spark, operator, target, least):
    sf = "/root/testdata/sf0.01"
    rows = operator(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", F.col(target).alias("y")).collect()
    good, bad = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) >= least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module, target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, empty, module, target):
    none = spark.createDataFrame([], f"doc_id long, {target} int")
    assert {r.score for r in module.classify(odd, none, ["doc_id"]).collect()} == {0.5}
    one_class = spark.createDataFrame([(i, 1) for i in range(20)], f"doc_id long, {target} int")
    assert min(r.score for r in module.classify(odd, one_class, ["doc_id"]).collect()) > 0.8
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(None, 1), (2, 7)], f"doc_id long, {target} int")
    got = module.classify(odd, labels, ["doc_id", "label"])
    assert got.count() == odd.count() and got.columns == ["doc_id", "label", "score"]
    assert module.classify(empty, labels, ["doc_id"]).count() == 0


def test_quality_stage_keeps_columns(spark, odd):
    got = quality.stage(spark, odd, SF)
    assert got.columns == odd.columns and got.count() <= odd.count()


def test_dual_coordinate_descent_meets_its_optimum():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.sort(rng.choice(50, 8, False)) for _ in range(60)]).astype(np.int32)
    first, y = np.arange(0, 481, 8), np.where(rng.random(60) < 0.5, 1, -1)
    ratio = np.zeros(quality.SIZE)
    ratio[:50] = rng.normal(size=50)
    weight, intercept = quality.dual_coordinate_descent(ids, first, y, ratio, np.arange(60), epochs=500, tolerance=1e-9)
    x = np.zeros((60, 51))
    for i in range(60):
        x[i, ids[first[i] : first[i + 1]]] = ratio[ids[first[i] : first[i + 1]]]
        x[i] /= np.linalg.norm(x[i])
        x[i, 50] = 1
    w = np.append(weight[:50], intercept)
    loss = lambda v: v @ v / 2 + np.maximum(1 - y * (x @ v), 0).sum()
    assert all(loss(w) <= loss(w + rng.normal(size=51) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    at, value = toxicity.isotonic(rng.normal(size=300), (rng.random(300) < 0.4).astype(float))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def test_isotonic_against_the_min_max_formula_with_ties():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.randrange(6), rng.randrange(2)) for _ in range(rng.randrange(1, 25))]
        levels = sorted({m for m, _ in rows})
        mean = lambda a, b: (lambda x: sum(x) / len(x))([t for m, t in rows if a <= m <= b])
        want = [max(min(mean(a, b) for b in levels if b >= m) for a in levels if a <= m) for m in levels]
        rng.shuffle(rows)
        at, value = toxicity.isotonic(*(np.array(c, float) for c in zip(*rows)))
        assert np.allclose(np.interp(levels, at, value), want)


@pytest.mark.parametrize("most, rows", [(10**6, 200), (1005, 100), (5, 0)])
def test_a_fit_is_bounded_in_bytes(spark, most, rows):
    sample = spark.range(200, numPartitions=3).select(F.col("id"), F.lit("ten bytes!").alias("text"))
    got = in_one_task(sample, [F.desc("id")], "text", most, lambda t: (t.num_rows, t["id"][0].as_py()))
    assert got == ((rows, 199) if rows else None)


def test_toxicity_sees_through_look_alikes(spark):
    base = toxicity.hashes_of(toxicity.LEXICON)
    none = np.zeros(0, np.uint64)
    x, _ = toxicity.features(pa.array(["you st*pid 1d10t", "a fine day", "You are an idiot!"]), base, none, none, toxicity.hashes_of(toxicity.SECOND_PERSON))
    assert x[0, 4] > 0 and x[1, :8].sum() == 0 and x[2, 0] > 0 and x[2, 6] > 0


# ---- language ----


def bucket_of(gram, bits=language_id.BITS):
    """A character n-gram's bucket, by the hash that the operator states."""
    value = 0
    for i, c in enumerate(gram):
        value = ord(c) if i == 0 else (value * 0x01000193 + ord(c)) & 0xFFFFFFFF
    for shift, factor in ((15, 0x9E3779B1), (13, 0x85EBCA6B)):
        value = value * factor & 0xFFFFFFFF
        value ^= value >> shift
    return (value ^ len(gram) * 0x51ED27 & 0xFFFFFFFF) & (1 << bits) - 1


def grams_of(text):
    plain = "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text or "")
    return Counter(bucket_of(plain[i : i + n]) for n in language_id.ORDERS for i in range(len(plain) - n + 1))


@pytest.mark.parametrize("block", [256, 2])
def test_language_against_plain_bayes(spark, monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    rows = docs.collect()
    grams, counts, number = {r.doc_id: grams_of(r.text) for r in rows}, defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang] += grams[r.doc_id]
            number[r.lang] += 1
    langs, size = sorted(counts), 1 << language_id.BITS
    below = {k: sum(counts[k].values()) + size * language_id.ALPHA for k in langs}
    train = docs.where(~F.col("doc_id").isin([r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]))
    got = {r.doc_id: r for r in language_id.identify(docs, train, ["doc_id"]).collect()}
    assert len(got) == len(rows) and len(langs) > 2
    for r in rows[:120]:
        log = [math.log(number[k] / sum(number.values())) + sum(n * math.log((counts[k][g] + language_id.ALPHA) / below[k]) for g, n in grams[r.doc_id].items()) for k in langs]
        best = max(range(len(langs)), key=lambda i: log[i])
        assert got[r.doc_id].lang_pred == (langs[best] if any(c.isalpha() for c in r.text or "") else "und")
        if got[r.doc_id].lang_pred != "und":
            assert math.isclose(got[r.doc_id].score, 1 / sum(math.exp(x - log[best]) for x in log), abs_tol=2e-3)


def test_language_of_held_out_documents(spark):
    out = {r.doc_id: r for r in language_id.op8(spark, SF).collect()}
    held = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(out[r.doc_id].held_out for r in held)


def test_language_on_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in language_id.identify(odd, odd, ["doc_id", "rep"]).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (0, 1, 2, 10))
    assert got[5].lang_pred == "en" and 0 < got[5].score <= 1
    assert {r.lang_pred for r in language_id.identify(odd, empty, ["doc_id"]).collect()} == {"und"}
    clash = odd.select("doc_id", "text", "lang", F.col("rep").alias("_letter"), F.col("rep").alias("_best"), F.col("rep").alias("lang_pred_"))
    assert language_id.identify(clash, odd, ["doc_id", "_letter", "_best"]).columns == ["doc_id", "_letter", "_best", "lang_pred", "score"]
    assert language_id.identify(empty, odd, ["doc_id"]).count() == 0


# ---- decontamination ----


def test_decontamination_against_containment(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plain = lambda t: b" ".join((t or "").encode().lower().translate(None, bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])).split())
    texts = {r.item_id: plain(r.text) for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if b" " + t + b" " in b" " + plain(d.text) + b" "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and want <= got and len(got - want) <= 1


def test_paraphrases_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, 40)) for i in range(20)]
    rows, planted = [], set()
    for d in range(150):
        words = prose(rng, 200).split()
        if d % 10 == 0:
            copy = items[d // 10][1].split()
            for k in range(0, 40, 8):
                copy[k] = "changed"
            words[60:60] = [w.upper() + "," for w in copy]
            planted.add(d)
        rows.append((d, " ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {r.doc_id for r in got} == planted
    assert all(abs(r.start_word - 60) <= 15 for r in got)


def test_cosine_bound_loses_no_edited_copy(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(100).collect()]
    vocabulary, rng = [w for r in docs.limit(200).collect() for w in (r.text or "").split()], random.Random(3)
    rows = []
    for i, (_, text) in enumerate(items * 4):
        words = [w if rng.random() < 0.65 else rng.choice(vocabulary) for w in text.split()]
        at = rng.randrange(len(vocabulary) - 200)
        rows.append((i, " ".join([*vocabulary[at : at + 60], *words, *vocabulary[at + 60 : at + 120]])))
    copies, model = spark.createDataFrame(rows, "doc_id long, text string"), decontaminate.fit(docs)
    found = lambda: {(r.doc_id, r.item_id) for r in decontaminate.search(copies, items, model).collect()}
    got = found()
    monkeypatch.setattr(decontaminate, "COSINE", -1.0)
    assert len(found() - got) <= 1


def test_latent_space_is_fitted_on_all_documents(spark):
    docs = spark.range(24_000, numPartitions=4).selectExpr("id AS doc_id", "'one two three four' AS text")
    _, values = decontaminate.fit_space(docs, np.ones(1 << decontaminate.BITS))
    assert math.isclose(values[0], math.sqrt(24_000), rel_tol=1e-3)


def test_decontamination_on_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "never seen before here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()}
    assert {(3, 3), (4, 3)} <= got and all(i == 3 for _, i in got)
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("item_id < 0")).count() == 0


def test_decontamination_stage_with_null_and_repeated_identifiers(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy(F.desc(F.length("text"))).first().text
    rows = [(None, item, "leak"), (None, "a clean text of no item", "clean"), (7, item, "leak"), (7, "another clean text", "clean"), (8, None, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("_row", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("_k0", F.lit(3))
    got = decontaminate.stage(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.kind for r in got.collect()) == ["clean"] * 3


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    model = decontaminate.fit(docs)
    want = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, model).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert want and sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, model).collect()) == want
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.clean(docs, items, model).collect()} == {d for d, _ in want}


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b) + 1), lambda best, j, row=row, x=x: max(best, row[j], row[j - 1] + 1 if b[j - 1] == x else 0) if j else 0))
        assert decontaminate.common_subsequence(np.array(a), np.array(b)) == row[-1]


# ---- sharding ----


def check_shards(rows, shards=8):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return [sum(r.size for r in by[s]) for s in range(shards)]


def test_sharding_law(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sharding.shard(docs).collect()
    load = check_shards(rows)
    assert len(rows) == docs.count() and max(load) - min(load) <= 0.01 * sum(load) / 8
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def numbered_texts(spark, n, hot):
    text = F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" and more of it"))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(hot, "one text for very many of the rows").otherwise(text).alias("text"))


@pytest.mark.parametrize("null_ids", [False, True])
def test_sharding_with_a_hot_text(spark, null_ids):
    docs = numbered_texts(spark, 6000, F.col("id") % 3 == 0)
    if null_ids:
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    load = check_shards(sharding.shard(docs).collect())
    assert max(load) - min(load) <= 0.02 * sum(load) / 8


def shards_of_texts(rows):
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    return where


def test_sharding_spreads_no_text_but_one_that_exceeds_a_shard(spark):
    small = spark.range(100, 300).select((F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("a group of five "), (F.col("id") % 40).cast("string")).alias("text"))
    hot = numbered_texts(spark, 3000, F.lit(True))
    where = shards_of_texts(sharding.shard(hot.union(small), slots=4).collect())  # every group shares a slot with others
    assert sorted(map(len, where.values())) == [1] * 40 + [8]
    fits = numbered_texts(spark, 3000, F.col("id") < 300)  # four fifths of a shard
    assert set(map(len, shards_of_texts(sharding.shard(fits).collect()).values())) == {1}


def test_sharding_edits_a_stored_map(spark, odd):
    path = Scratch(spark, "map").path("map")
    docs = numbered_texts(spark, 4000, F.lit(False))
    place = lambda rows: {r.doc_id: r.shard for r in rows}
    first = sharding.shard(docs, map_path=path).collect()
    version = sharding.latest_version(spark, path)
    again = sharding.shard(docs, map_path=path).collect()
    assert len(first) == len(again) == 4000 and place(first) == place(again) and sharding.latest_version(spark, path) == version
    more = sharding.shard(docs, shards=9, map_path=path).collect()
    load = check_shards(more, 9)
    moved = {i for i, s in place(more).items() if s != place(first)[i]}
    assert max(load) - min(load) <= 0.02 * sum(load) / 9
    assert 0.05 * 4000 < len(moved) < 0.2 * 4000 and sum(place(more)[i] == 8 for i in moved) > 0.97 * len(moved)
    assert sharding.latest_version(spark, path) == version + 1
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(spark, path, version, {(0, 0): 1})


def test_sharding_versions_and_odd_rows(spark, odd, empty):
    path = Scratch(spark, "map").path("map")
    rows = sharding.shard(odd, shards=3, map_path=path).collect()
    check_shards(rows, 3)
    assert len(rows) == odd.count() and {r.size for r in rows if r.doc_id in (0, 1)} == {1}
    last = sharding.latest_version(spark, path)
    first, second = sharding.load_map(spark, path, 0), sharding.load_map(spark, path, last)
    assert first.count() == second.count() and first.join(second, ["vslot", "sub"]).count() == first.count()
    assert sharding.shard(empty).count() == 0 and sharding.stage(spark, empty, SF).count() == 0
    assert sharding.stage(spark, odd, SF).count() == odd.count()


# ---- mixing ----


def test_budgets_by_hand(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 10, 1), ("d", "en", "b", 1000, 1), ("d", "fr", "c", 20, 1), ("e", "en", "f", 5000, 1)], "domain string, lang string, source string, tokens long, rows long")
    even = {k: F.lit(1.0) for k in mixing.LEVELS}
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(800), even, 1).collect()}
    assert got == {"a": 10, "b": 370, "c": 20, "f": 400}  # a's and c's shortages stay in their domain
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(4000), even, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 20, "f": 2970}  # only then does the other domain get them


def test_mixing_prefix_on_odd_rows(spark, odd, empty):
    rows = mixing.mix(odd, ["doc_id", "rep"], part=0.5, max_epochs=3).collect()
    assert len(rows) == odd.count()
    used, budget = Counter(), {}
    tokens = {r.doc_id: len(words_of(r.text)) for r in odd.collect()}
    for r in rows:
        used[tuple(r._leaf)] += r._copies * tokens[r.doc_id]
        budget[tuple(r._leaf)] = r._budget
    assert all(used[leaf] <= budget[leaf] for leaf in budget)
    assert mixing.mix(empty, ["doc_id"]).count() == 0
    assert mixing.stage(spark, odd, SF).columns == odd.columns
    assert mixing.stage(spark, empty, SF).count() == 0


def test_mixing_of_rows_without_identifiers(spark):
    docs = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert {r.copies for r in mixing.allocate(docs, part=0.5, max_epochs=1).collect()} == {0}  # they share a place, which the budget does not reach
    assert {r.copies for r in mixing.allocate(docs, part=1.0, max_epochs=1).collect()} == {1}


# ---- exact duplicates ----


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", ["sha256", "weak"])
def test_exact_dedup(spark, odd, tmp_path, digest):
    odd.repartition(5).write.parquet(str(tmp_path / "t"))
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 2, "0"))  # noqa: E731  digests that clash
    rows = exact_dedup.dedup(spark, str(tmp_path / "t"), exact_dedup.sha256 if digest == "sha256" else weak, files_per_batch=2).collect()
    groups, texts = plain_groups(odd.collect()), defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    assert len(rows) == odd.count()
    for r in rows:
        (text,) = texts[r.doc_id] if len(texts[r.doc_id]) == 1 else [t for t in texts[r.doc_id] if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert (r.keep_id, r.group_size) == groups[text] and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups)


def test_exact_dedup_goes_on_from_an_earlier_run(spark, odd, tmp_path):
    path, checkpoint = f"{tmp_path}/t/", f"file://{tmp_path}/state"
    odd.coalesce(1).write.parquet(path)
    exact_dedup.dedup(spark, path, checkpoint=checkpoint).collect()
    odd.where("doc_id IN (5, 6, 9)").withColumn("doc_id", F.col("doc_id") + 100).coalesce(1).write.mode("append").parquet(path)
    rows = {r.doc_id: r for r in exact_dedup.dedup(spark, path, checkpoint=checkpoint).collect()}
    assert (rows[5].keep_id, rows[5].group_size, rows[106].kept) == (106, 5, True)
    assert (rows[9].keep_id, rows[9].group_size) == (109, 2) and rows[7].group_size == 1
    batches = [p.name for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit()]
    assert len(batches) >= 2


def test_exact_dedup_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "t"))
    assert exact_dedup.dedup(spark, str(tmp_path / "t")).count() == 0


# ---- near duplicates ----


def plain_components(rows, n=2, percent=80):
    sets = {}
    for r in rows:
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n_families, copies, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_families):
        base = text_of(rng, 120, 50_000).split()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("copies, edits, cell", [(4, 12, 2048), (60, 16, 2048), (60, 16, 10)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, copies, edits, cell):
    """Families whose members are linked only in part; small cells exercise the blocks and the dense path."""
    monkeypatch.setattr(minhash, "CELL", cell)
    docs = spark.createDataFrame(families(copies, 120 // copies, copies, edits), "doc_id long, text string")
    want = plain_components(docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert all(got[i].n_shingles == 0 and got[i].component_id == i and got[i].kept for i in (0, 1, 2))
    assert got[3].component_id == got[4].component_id == 3 and got[3].n_shingles == 1
    assert {got[i].component_id for i in (5, 6, 7, 11)} == {5}
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(empty).count() == 0
    clash = odd.withColumn("_id", F.lit(1)).withColumn("d1", F.lit(2)).withColumn("component_id", F.lit(3))
    kept = minhash.stage(spark, clash, SF)
    assert kept.columns == clash.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 1, 2, None} <= set(ids) and not {6, 7, 11} & set(ids)
    assert minhash.stage(spark, empty, SF).count() == 0


def test_crowded_documents_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 3)
    docs = spark.createDataFrame(families(60, 2, 60, 16), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == plain_components(docs.collect())


# ---- repeated passages ----


def test_repeated_passages(spark):
    rng = random.Random(6)
    passage, fuzzy = text_of(rng, 60, 10**6).split(), text_of(rng, 90, 10**6).split()
    rows, exact, near = [], {}, {}
    for d in range(60):
        words = text_of(rng, 150, 10**6).split()
        if d % 6 == 0:
            exact[d] = at = rng.randrange(100)
            words[at:at] = passage
        elif d % 6 == 1:
            near[d] = at = rng.randrange(100)
            words[at:at] = [w if rng.random() > 0.05 else "edit" for w in fuzzy]
        rows.append((d, " ".join(words)))
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == (set(exact) | set(near)) - {min(exact), min(near)}
    for r in got:
        at, size = (exact[r.doc_id], 60) if r.doc_id in exact else (near[r.doc_id], 90)
        assert abs(r.start_word - at) <= 25 and abs(r.end_word - at - size) <= 25


def test_passages_far_apart_are_each_reported(spark):
    rng = random.Random(16)
    one, two, *fill = (text_of(rng, n, 10**6) for n in (60, 60, 120, 120, 40, 40))
    rows = [(1, " ".join([fill[2], one, fill[0], two])), (2, " ".join([fill[3], one, fill[1], two]))]
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for r in got if (r.doc_id, r.other_id) == (2, 1) for w in range(r.start_word, r.end_word)}
    assert {*range(40, 100), *range(220, 280)} <= covered and len(covered) < 240
    assert all(r.share >= 0.8 for r in got)


def covered_words(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_passage_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(18)
    whole, *fill = (text_of(rng, n, 10**6) for n in (60, 90, 90, 90, 90))
    head, tail = " ".join(whole.split()[:30]), " ".join(whole.split()[30:])
    rows = [(d, f"{f} {part} {f.upper()[:40]}") for d, f, part in zip((1, 2, 3, 4), fill, (head, tail, whole, whole))]
    got = covered_words(substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got.keys() == {4} and {*range(90, 150)} <= got[4]


def test_passages_of_repeated_lines_single_seeds_and_second_places(spark):
    rng = random.Random(19)
    line, long_line, passage = (text_of(rng, n, 10**6) for n in (7, 30, 55))
    fill = [text_of(rng, 20, 10**6) for _ in range(12)]
    rows = [(1, " ".join([fill[0], *[line] * 40, fill[1]])), (2, " ".join([fill[2], *[line] * 40, fill[3]]))]
    rows += [(3, " ".join([fill[4], long_line, fill[5], *[long_line] * 6])), (4, " ".join([fill[6], *[long_line] * 6, fill[7]]))]
    rows += [(5, f"{fill[8]} {passage}"), (6, " ".join([passage, fill[9], passage, fill[10], fill[11], passage]))]
    got = covered_words(substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {*range(20, 300)} <= got[2] and {*range(20, 200)} <= got[4]
    assert {*range(55), *range(75, 130), *range(170, 225)} <= got[6]


def test_edited_passages_with_few_seeds(spark):
    rng = random.Random(20)
    rows, changed = [], lambda ws: [w if i % 6 < 5 or 22 < i < 38 else f"new{rng.random()}" for i, w in enumerate(ws)]
    for d in range(0, 60, 2):
        passage = text_of(rng, 60, 10**9).split()
        for k, words in enumerate((passage, changed(passage))):
            rows.append((d + k, " ".join([text_of(rng, 40, 10**9), *words, text_of(rng, 40, 10**9)])))
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {d + 1 for d in range(0, 60, 2)}


def edited(rng, words, share=0.08):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def mosaics(seed):
    """Documents that share edited passages, after documents that hold overlapping parts of the same passages."""
    rng = random.Random(seed)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    rows, late = [], []
    for _ in range(12):
        passage = fresh(160)
        for at in range(0, 130, 30):
            rows.append(fresh(30) + passage[at : at + 40] + fresh(30))
        late += [fresh(20) + edited(rng, passage) + fresh(20) for _ in range(3)]
    rng.shuffle(rows)
    return list(enumerate(rows + late))


def plain_repeats(texts, least=substrings.LEAST):
    """Words of each document that some smaller document repeats, by chains and alignments of all pairs, all k-mers being seeds."""
    out, words = defaultdict(set), {d: np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for d, t in texts}
    where = {d: defaultdict(list) for d in words}
    for d, t in texts:
        for i in range(len(t) - substrings.K + 1):
            where[d][tuple(t[i : i + substrings.K])].append(i)
    for d, other in itertools.permutations(words, 2):
        found = [(y, x) for k in where[d].keys() & where[other].keys() for y in where[d][k] for x in where[other][k]] if other < d else []
        if found:
            y, x = (np.array(c) for c in zip(*found))
            for _, path in substrings.chain(x, y):
                for y0, y1, *_ in substrings.passages(*substrings.align(words[d], words[other], y[path].tolist(), x[path].tolist()), least, 0.8):
                    out[d].update(range(y0, y1))
    return out


def test_recall_of_edited_passages_against_all_pairs(spark):
    texts = mosaics(31)
    want = plain_repeats(texts)
    got = covered_words(substrings.repeats(spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")).collect())
    all_ = sum(map(len, want.values()))
    hit = sum(len(want[d] & got[d]) for d in want)
    print("recall of words", hit / all_)
    assert all_ > 2000 and hit / all_ >= 0.9
    assert not set(got) - set(want)


def test_passages_whose_seeds_stand_in_many_earlier_documents(spark):
    rng = random.Random(41)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows = fresh(120), []
    for layer in range(5):
        for at in range(0, 120, 20):
            rows.append(fresh(30) + passage[max(at - 3 * layer, 0) : at + 30 - 3 * layer] + fresh(30))
    rows += [fresh(20) + [w if i % 16 else f"e{k}-{i}" for i, w in enumerate(passage)] + fresh(20) for k in range(4)]
    texts = list(enumerate(rows))
    want = plain_repeats(texts)
    got = covered_words(substrings.repeats(spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")).collect())
    assert {31, 32, 33} <= want.keys() and all(len(want[d] - got[d]) <= 0.02 * len(want[d]) for d in want)


def test_a_frequent_line_is_held_against_every_document(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CELLS", 16, raising=False)
    rng = random.Random(43)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    line, tail = fresh(16), fresh(54)
    rows = [fresh(30) + line + fresh(60) for _ in range(150)]
    # 54 words of which five of six are in common, with no seed but those of the line
    rows[97][46:] = tail
    rows[140][46:] = [w if i % 6 else f"e{i}" for i, w in enumerate(tail)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(rows)], "doc_id long, text string")
    got = substrings.repeats(docs).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(140, 97)} and all(r.share >= 0.8 for r in got)


def places_of_a_seed(rng, core, n, alike=()):
    """Rows of ``_compared``: a line of ``core`` words in ``n`` documents, other words around it but for the pairs in ``alike``."""
    around = np.array([[rng.randrange(2, 256) for _ in range(substrings.AROUND)] for _ in range(n)], np.uint8)
    around[:, substrings.SIDE : substrings.SIDE + core] = 7
    for a, b in alike:
        around[a] = [w if i % 6 else rng.randrange(2, 256) for i, w in enumerate(around[b].tolist())]
    zero, doc = pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n))
    columns = {"seed": pa.array(np.zeros(n, np.int64)), "low": zero, "high": zero, "own": zero, "doc": doc, "y": pa.array(np.full(n, 200, np.int32)), "open": pa.array(np.ones(n, bool))}
    columns |= {"near": pa.array([[]] * n, pa.list_(pa.int64())), "step": pa.array([[]] * n, pa.list_(pa.int32())), "words": pa.array([w.tobytes() for w in around], pa.binary())}
    return pa.RecordBatch.from_pydict(columns)


def test_a_run_too_short_for_a_passage_is_not_dense():
    equal = np.zeros((3, substrings.AROUND), bool)
    equal[0, 100:145] = equal[1, 100:150] = equal[2, 100:145] = equal[2, 150:153] = True
    assert substrings._dense(equal, 50, 0.8).tolist() == [False, True, True]


def test_places_that_are_looked_up_are_those_of_all_pairs(monkeypatch):
    for core in (6, 16, 24, 36):
        rng = random.Random(core)
        rows = places_of_a_seed(rng, core, 220, [(150 + k, rng.randrange(150)) for k in range(30)])
        found = []
        for many in (10**9, 0):
            monkeypatch.setattr(substrings, "MANY", many)
            found.append({(r["doc"], r["other"]) for b in substrings._compared([rows], 50, 0.8) for r in b.to_pylist()})
        assert found[0] == found[1] and len(found[0]) >= 25


def test_copies_of_a_text_go_as_one(spark):
    rng = random.Random(33)
    text, other = text_of(rng, 90, 10**9), text_of(rng, 30, 10**9)
    docs = spark.range(2000).select((F.col("id") + 5).alias("doc_id"), F.when(F.col("id") % 2 == 0, text).otherwise(other).alias("text"))
    docs = docs.union(spark.createDataFrame([(2, text + " more words"), (None, text)], "doc_id long, text string"))
    got = substrings.repeats(docs).collect()
    assert len(got) == 1000 and {r.words_in_common for r in got} == {90}
    assert {(r.doc_id, r.other_id) for r in got} == {(5, 2)} | {(d, 5) for d in range(7, 2005, 2)}


def test_every_exact_run_is_reported(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IS NOT NULL")
    texts = {r.doc_id: textvec.plain_words(pa.array([r.text], pa.string())).hash.tolist() for r in docs.collect()}
    want, seen = defaultdict(set), {}
    for d in sorted(texts):
        runs = [tuple(texts[d][i : i + 50]) for i in range(len(texts[d]) - 49)]
        for i, run in enumerate(runs):
            if seen.get(run, d) != d:
                want[d].update(range(i, i + 50))
        for run in runs:
            seen.setdefault(run, d)
    rows = substrings.repeats(docs).collect()
    got = covered_words(rows)
    assert want and all(words <= got[d] for d, words in want.items())
    assert all(texts[r.doc_id][r.start_word : r.end_word] == texts[r.other_id][r.other_start : r.other_end] for r in rows if r.share == 1)


def test_passages_of_an_alignment():
    rng = random.Random(17)
    for _ in range(200):
        n = rng.randrange(1, 80)
        y, x = (np.array(sorted(rng.sample(range(rng.choice((n, n + 9, 2 * n))), n))) for _ in "yx")
        size = lambda i, j: max(y[j] - y[i], x[j] - x[i]) + 1
        want = max((j - i + 1 for i in range(n) for j in range(i, n) if j - i + 1 >= 0.8 * size(i, j) and y[j] - y[i] >= 9), default=0)
        found = substrings.passages(y, x, 10, 0.8)
        assert max((p[-1] for p in found), default=0) == want


def test_chain_against_all_predecessors():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(2, 40)
        x, y = (np.array(rng.sample(range(200), n)) for _ in "xy")
        best = {}
        for i in np.argsort(x):
            best[i] = 6 + max([0.0, *(best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i])])
        found = substrings.chain(x, y)
        assert math.isclose(found[0][0], max(best.values()), abs_tol=1e-9)
        for _, path in found:
            assert (np.diff(x[path]) > 0).all() and (np.diff(y[path]) > 0).all()
        assert sorted(i for _, p in found for i in p) == list(range(n))


def test_repeats_on_odd_rows(spark, odd, empty):
    got = substrings.repeats(odd).collect()
    assert {r.doc_id for r in got} == {6, 7, 11} and {r.other_id for r in got} == {5}
    assert substrings.repeats(empty).count() == 0


# ---- language model ----


def test_language_model_counts_and_gain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in language_model.op10(spark, SF).collect()}
    tokens = {r.doc_id: [*words_of(r.text), None] for r in rows}
    train = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    total, distinct = sum(train.values()), len(train)
    for i, ts in tokens.items():
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(train[t] > 0 for t in ts), total)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_rounds_take_every_position():
    first = np.array([0, 1, 3, 20, 21, 29])
    taken = np.concatenate([language_model.positions(first, turn) for turn in range(language_model.ROUNDS)])
    assert sorted(taken.tolist()) == list(range(29))
    assert set(first[:-1]) <= set(language_model.positions(first, 0).tolist())


def test_language_model_tasks_start_alike_in_a_reused_worker(spark):
    share = np.random.default_rng(5).random(language_model.BOS)
    text, scratch = F.lit("one two three four five six seven " * 60), Scratch(spark, "test")
    found = []
    for tasks in (1, 40):
        model = language_model.LogBilinear(share / share.sum())
        language_model._train_round(spark.range(0, tasks, 1, tasks).select(text.alias("text")), model, np.zeros(0, np.uint64), 0, scratch)
        found.append(model)
    start = language_model.LogBilinear(share / share.sum())
    for name in start.NAMES:
        one, many, before = (getattr(m, name) for m in (*found, start))
        assert np.abs(one - before).max() > 1e-3 and np.allclose(one, many, atol=1e-6)


def test_language_model_step_is_the_gradient_of_the_loss():
    rng = np.random.default_rng(9)
    share = rng.random(language_model.BOS)
    model = language_model.LogBilinear(share / share.sum())
    one, two, target = (rng.integers(0, 40, 64) for _ in range(3))
    noise, k = rng.integers(0, 40, language_model.NOISE), language_model.NOISE
    r, b, d = (getattr(model, n).astype(float).copy() for n in ("r", "b", "d"))
    gr, gb, gd = np.zeros_like(r), np.zeros_like(b), np.zeros_like(d)
    for i in range(64):
        q = d[0] * r[one[i]] + d[1] * r[two[i]]
        gq = np.zeros_like(q)
        for c, true in [(target[i], 1), *((n, 0) for n in noise)]:
            pull = true - 1 / (1 + np.exp(-(q @ r[c] + b[c] - np.log(k * model.share[c]))))
            gr[c] += pull * q / 64
            gb[c] += pull / 64
            gq += pull * r[c]
        for j, c in enumerate((one[i], two[i])):
            gr[c] += gq * d[j] / 64
            gd[j] += gq * r[c] / 64
    model.step(one, two, target, noise)
    for name, start, gradient in zip("rbd", (r, b, d), (gr, gb, gd)):
        assert np.allclose(getattr(model, name), start + language_model.RATE * gradient / np.sqrt(1e-2 + gradient**2), atol=1e-5), name


def test_language_model_is_normalised():
    rng = np.random.default_rng(3)
    share = rng.random(language_model.BOS)
    model = language_model.LogBilinear(share / share.sum())
    for _ in range(20):
        model.step(*(rng.integers(0, language_model.BOS, 64) for _ in range(3)), rng.integers(0, language_model.BOS, language_model.NOISE))
    score, norm = model.tables()
    for one, two in ((0, 5), (language_model.BOS, language_model.BOS), (17, language_model.BOS)):
        assert math.isclose((10.0 ** (score[0, one].astype(float) + score[1, two] - norm[one, two])).sum(), 1, rel_tol=1e-3)


@pytest.mark.parametrize("frequent", [500_000, 40])
def test_language_model_scores_token_by_token(spark, monkeypatch, frequent):
    """Each token's probability is its class's, by a plain softmax over all classes, times its share of the class."""
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    rng, kept, scratch, most = random.Random(21), [], Scratch(spark, "test"), language_model.HEAD
    docs = spark.createDataFrame([(i, prose(rng, 100)) for i in range(60)] + [(60, None), (61, "never seen")], "doc_id long, text string")
    tables = language_model.LogBilinear.tables
    monkeypatch.setattr(language_model.LogBilinear, "tables", lambda self: (kept.append(self), tables(self))[1])
    model = language_model.fit(docs.where("doc_id < 50"), scratch)
    got = {r.doc_id: r.score for r in language_model.score(docs, model, scratch, ["doc_id"]).collect()}
    train = Counter(t for r in docs.where("doc_id < 50").collect() for t in [*words_of(r.text), None])
    mark = {t: language_model.END if t is None else textvec.words(pa.array([t])).hash[0] for t in {*train, b"never", b"seen"}}
    head = sorted(sorted(train, key=lambda t: (-train[t], int(mark[t].view(np.int64))))[:most], key=lambda t: int(mark[t]))
    assert len(train) > most == len(head)
    place = {t: i for i, t in enumerate(head)}
    tail_of = lambda t: int(language_model._tokens(pa.RecordBatch.from_arrays([pa.array([t.decode()])], ["text"]))[1][0])
    class_of = lambda t: place[t] if t in place else most + tail_of(t)
    within = defaultdict(list)
    for t, n in train.items():
        if t not in place:
            within[tail_of(t)].append(n)
    lbl = kept[-1]
    r, b, d = (x.astype(float) for x in (lbl.r, lbl.b, lbl.d))
    for row in docs.collect():
        total, before = 0.0, [language_model.BOS] * 2
        for t in [*words_of(row.text), None]:
            c = class_of(t)
            logits = r[: language_model.BOS] @ (d[0] * r[before[-1]] + d[1] * r[before[-2]]) + b
            share = 1.0 if c < most else (train[t] + 0.1) / (sum(within[c - most]) + 0.1 * (len(within[c - most]) + 1))
            total += math.log10(math.exp(logits[c] - logits.max()) / np.exp(logits - logits.max()).sum() * share)
            before.append(c)
        assert math.isclose(got[row.doc_id], total, rel_tol=1e-3, abs_tol=1e-3)


def test_language_model_on_odd_rows(spark, odd, empty):
    scratch = Scratch(spark, "test")
    rows = language_model.score(odd, language_model.fit(odd, scratch), scratch, ["doc_id", "score"]).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and all(got[i].n_tokens == 1 for i in (0, 1, 2)) and all(math.isfinite(r[-1]) for r in rows)
    blank = language_model.score(odd, language_model.fit(empty, scratch), scratch, ["doc_id"]).collect()
    assert {(r.n_known, r.train_tokens) for r in blank} == {(0, 0)}
    assert language_model.score(empty, language_model.fit(odd, scratch), scratch, ["doc_id"]).count() == 0


# ---- the pipeline ----


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    extra = odd.withColumn("_row", F.lit(1)).withColumn("_id", F.lit(1)).withColumn("_k0", F.lit(1)).withColumn("_leaf", F.lit(1)).withColumn("shard", F.lit(1))
    for docs in (extra, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
        kept = docs.count()
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(rows) == kept
        check_shards(rows)


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in rows]
    assert 0 < len(ids) == len(set(ids)) < docs.count()
    check_shards(rows)
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not leaks & set(ids)
    kept = docs.where(F.col("doc_id").isin(ids)).collect()
    assert all(c == i for i, (_, c) in plain_components(kept, n=5).items())
