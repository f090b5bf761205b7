"""The classifiers' features, models and scores against plain loops over single texts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelattice.llm import quality, textvec, toxicity
from sitelattice.llm.labels import training_sample

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  ", "!?", "You IDIOT, 1d10t!!! aaa", "straße ÄÖ 漢字 x1 x1 x1 X_1", "one", "a a a a b", "st*pid you, your m0ron\tloooser"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(60).collect()
    return ODD + [r.text for r in rows]


def hash_of(word: bytes) -> int:
    return int(textvec.words(pa.array([word], pa.binary()), lower=False).hash[0])


def mixed(x: int, seed: int = 0) -> int:
    return int(textvec.mix(np.array([x & (1 << 64) - 1], np.uint64), seed)[0])


# ---- quality ----


def plain_buckets(text) -> set[int]:
    """Buckets of word 1- and 2-grams, of byte 3-grams and of n-grams of word shapes, one n-gram at a time."""
    data = (text or "").encode()
    words = data.split()
    out, known = set(), {w: hash_of(w) for w in set(words)}
    for a in words:
        out.add(known[a] & (1 << quality.WORD_BITS) - 1)
    for a, b in zip(words, words[1:]):
        out.add(mixed((known[a] * 0xA0761D6478BD642F + known[b]) & (1 << 64) - 1, 1) & (1 << quality.WORD_BITS) - 1)
    folded = bytes(0x20 if c in b"\t\n\x0b\x0c\r" else c for c in data)
    for i in range(len(folded) - 2):
        value = folded[i]
        for c in folded[i + 1 : i + 3]:
            value = (value * 0x01000193 + c) & 0xFFFFFFFF
        for shift, factor in ((15, 0x9E3779B1), (13, 0x85EBCA6B)):
            value = value * factor & 0xFFFFFFFF
            value ^= value >> shift
        out.add((1 << quality.WORD_BITS) + (value & (1 << quality.CHAR_BITS) - 1))
    shapes = []
    for i, w in enumerate(words):
        kinds = {1 if c >= 128 or chr(c).islower() else 2 if chr(c).isupper() else 4 if chr(c).isdigit() else 8 for c in w}
        shapes.append(sum(kinds) | (i > 0 and words[i - 1] == w) << 4)
    for n in (1, 2, 3):
        for i in range(len(shapes) - n + 1):
            value = sum(s << 8 * k for k, s in enumerate(shapes[i : i + n]))
            out.add((1 << quality.WORD_BITS) + (1 << quality.CHAR_BITS) + (mixed(value, n) & (1 << quality.SHAPE_BITS) - 1))
    return out


def test_quality_features_against_loops(texts):
    ids, first = quality.features(pa.array(texts))
    for text, a, b in zip(texts, first[:-1], first[1:]):
        assert set(ids[a:b].tolist()) == plain_buckets(text), text


def test_quality_scores_against_loops(spark, texts):
    rng = random.Random(3)
    rows = [(i, t, rng.randrange(2)) for i, t in enumerate(texts)]
    labelled = [r for r in rows if r[0] % 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs.where("doc_id % 3 > 0"))
    ids, first = quality.features(pa.array(texts))
    buckets = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    counts = {y: Counter(b for i, _, label in labelled if label == y for b in buckets[i]) for y in (0, 1)}
    total = {y: sum(c.values()) + quality.SIZE for y, c in counts.items()}
    ratio = lambda b: math.log((counts[1][b] + 1) / total[1]) - math.log((counts[0][b] + 1) / total[0])
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    for i, own in enumerate(buckets):
        size = math.sqrt(sum(ratio(b) ** 2 for b in own)) or 1.0
        margin = sum(ratio(b) / size * float(model["weight"][b]) for b in own) + model["intercept"]
        assert math.isclose(got[i], 1 / (1 + math.exp(-(model["slope"] * margin + model["offset"]))), abs_tol=1e-4)
    # the slope and offset are where the logistic loss of softened targets is flat
    margins, y = np.array([rng.gauss(0, 1) for _ in range(80)]), np.array([rng.choice((-1, 1)) for _ in range(80)])
    slope, offset = quality.platt(margins, y)
    target = np.where(y > 0, (sum(y > 0) + 1) / (sum(y > 0) + 2), 1 / (sum(y < 0) + 2))
    rest = 1 / (1 + np.exp(-(slope * margins + offset))) - target
    assert abs(rest.sum()) < 1e-4 and abs((rest * margins).sum()) < 1e-4


# ---- toxicity ----


def letters_only(text, undo=False) -> list[bytes]:
    data = (text or "").encode()
    if undo:
        data = data.translate(toxicity.LOOK_ALIKES)
    marks = {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(48, 58)}
    return bytes(c for c in data if c not in marks).lower().split()


def plain_dense(text, learned: set[int], stems: set[int]) -> list[float]:
    """The dense features of one text, word by word and byte by byte."""
    data, plain, undone = (text or "").encode(), letters_only(text), letters_only(text, True)
    base, second = ({w.encode() for w in ws} for ws in (toxicity.LEXICON, toxicity.SECOND_PERSON))
    n = max(len(plain), 1)
    in_base, in_learned = [w in base for w in plain], [hash_of(w) in learned for w in plain]
    stem = lambda w, k: mixed(int.from_bytes(w[:k], "little"), 900 + k)
    in_stems = [any(len(w) > k and stem(w, k) in stems for k in toxicity.STEMS) for w in plain]
    person = [w in second for w in plain]
    hits = [i for i in range(len(plain)) if in_base[i] or in_learned[i] or in_stems[i]]
    near = sum(any(person[j] for j in range(max(i - toxicity.NEAR, 0), min(i + toxicity.NEAR + 1, len(plain)))) for i in hits)
    hidden = max(sum(w in base for w in undone) - sum(in_base), 0)
    upper, letters = sum(65 <= c <= 90 for c in data), sum(c >= 128 or chr(c).isalpha() for c in data)
    size = max(len(data), 1)
    marks = sum(c in {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)} for c in data)
    same = sum(data[i] == data[i - 1] == data[i - 2] for i in range(2, len(data)))
    return [
        sum(in_base) / n, math.log1p(sum(in_base)), sum(in_learned) / n, math.log1p(sum(in_learned)), hidden / n, math.log1p(hidden), near / n, math.log1p(near), sum(person) / n,
        upper / max(letters, 1), sum(c in b"!?" for c in data) / size, marks / size, sum(48 <= c <= 57 for c in data) / size, letters / size, same / size, math.log1p(len(plain)), sum(in_stems) / n, math.log1p(sum(in_stems)),
    ]


def walk(tree, edges, row) -> float:
    feature, cut, value = tree
    node = 0
    while node < len(feature):
        j = feature[node]
        node = 2 * node + 1 + (sum(e < row[j] for e in edges[j]) > cut[node])
    return value[node - len(feature)]


def test_toxicity_scores_against_loops(spark, texts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(training_sample(docs, labels, "toxic", 200))
    assert model["trees"] is not None
    learned, stems = set(model["learned"].tolist()), set(model["stems"].tolist())
    dense, _ = toxicity.features(pa.array(texts), model["base"], model["learned"], model["stems"], model["second"])
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(given, model, ["doc_id"]).collect()}
    trees, (at, value) = model["trees"], model["knots"]
    for i, text in enumerate(texts):
        row = plain_dense(text, learned, stems)
        assert np.allclose(dense[i], row, atol=1e-9), (i, text)
        margin = trees.start + sum(walk(t, trees.edges, row) for t in trees.trees)
        low = max([k for k in range(len(at)) if at[k] <= margin], default=0)
        high = min([k for k in range(len(at)) if at[k] >= margin], default=len(at) - 1)
        share = 0.0 if at[high] <= at[low] else (margin - at[low]) / (at[high] - at[low])
        assert math.isclose(got[i], value[low] + share * (value[high] - value[low]), abs_tol=1e-6)


def test_boosting_against_exhaustive_splits():
    """One tree of depth one takes the split, of all values of all features, that gains most."""
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 12, (90, 4)).astype(float), (rng.random(90) < 0.4).astype(float)
    y[x[:, 2] > 7] = 1
    trees = toxicity.Trees(rounds=1, depth=1, bins=64).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) if m.any() else 0.0
    best = max((gain(x[:, j] <= v) + gain(x[:, j] > v), j, v) for j in range(4) for v in np.unique(x[:, j])[:-1])
    feature, cut, _ = trees.trees[0]
    right = np.searchsorted(trees.edges[feature[0]], x[:, feature[0]], "left") > cut[0]
    assert feature[0] == best[1] and math.isclose(gain(right) + gain(~right), best[0], rel_tol=1e-9)


def test_sample_ignores_other_labels_and_repeats(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 5), (4, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.label for r in training_sample(docs, labels, "toxic", 100).collect()}
    assert got.items() <= {1: 1, 4: 1}.items() and got
