"""Quality classifier: naive Bayes support vectors.

Features are indicators of word 1- and 2-grams, of byte 3-grams and of n-grams
of word shapes (case, symbols, digits, repeats the word before), hashed into a
fixed number of buckets.  Each indicator is scaled by its class log-count
ratio, rows are brought to unit length, and a linear hinge-loss model is fitted
by dual coordinate descent.  Margins of a two-fold split calibrate the score.

The fit reads at most ``sample_rows`` labelled rows of the training fold, and
``SAMPLE_BYTES`` of their features, documented bounds; one task on an executor fits it.
Scoring covers every whole text in one pass without a shuffle.

Cases: a null text scores as an empty one, from the intercept alone.  With no
labelled rows every score is 0.5; with labels of one class it is that class's
smoothed share.  Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm import textvec
from sitelattice.llm.labels import held_out, sample_order, training_sample
from sitelattice.llm.runtime import in_one_task, own_names, renamed, segment_sum, sigmoid, table

WORD_BITS, CHAR_BITS, SHAPE_BITS = 17, 16, 12
#: Labelled rows, and bytes of their feature numbers, that a fit reads at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 128 << 20
SIZE = (1 << WORD_BITS) + (1 << CHAR_BITS) + (1 << SHAPE_BITS)

_KIND = np.full(256, 8, np.uint8)  # symbols
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4


def _shapes(words: textvec.Words) -> np.ndarray:
    """A number below 64 for each word: which kinds of bytes it has, whether it repeats the word before."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    kinds = np.bitwise_or.reduceat(_KIND[words.data], np.stack([words.start, words.end - 1], 1).ravel())[::2] | _KIND[words.data[words.end - 1]]
    same = np.zeros(len(kinds), np.uint64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    return kinds.astype(np.uint64) | same << np.uint64(4)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bucket numbers of all rows end to end, and where each row's begin."""
    words = textvec.words(column, lower=False)
    parts = []
    for n in (1, 2):
        value, start = words.grams(n)
        parts.append((words.doc[start], value & np.uint64((1 << WORD_BITS) - 1)))
    value, first = textvec.char_grams(words.data, words.at, 3)
    parts.append((np.repeat(np.arange(len(first) - 1), np.diff(first)), (value & np.uint32((1 << CHAR_BITS) - 1)).astype(np.uint64) + np.uint64(1 << WORD_BITS)))
    shape = _shapes(words)
    for n in (1, 2, 3):
        if len(shape) >= n:
            value = textvec.mix(sum((shape[i : len(shape) - n + 1 + i] << np.uint64(8 * i) for i in range(1, n)), shape[: len(shape) - n + 1]), n)
            inside = words.doc[: len(value)] == words.doc[n - 1 :]
            parts.append((words.doc[: len(value)][inside], (value[inside] & np.uint64((1 << SHAPE_BITS) - 1)) + np.uint64((1 << WORD_BITS) + (1 << CHAR_BITS))))
    keys = np.unique(np.concatenate([d.astype(np.uint64) * np.uint64(1 << 18) + v for d, v in parts]))
    owner = (keys >> np.uint64(18)).astype(np.int64)
    return (keys & np.uint64((1 << 18) - 1)).astype(np.int32), np.searchsorted(owner, np.arange(len(words.at)))


def _pieces(rows: int, most: int = 512):
    """Row ranges that are worked on at once, so that what is computed from them stays small."""
    return ((a, min(a + most, rows)) for a in range(0, rows, most))


def log_count_ratio(ids: np.ndarray, first: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    good, bad = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for a, b in _pieces(len(y)):
        owner, part = np.repeat(y[a:b] > 0, np.diff(first[a : b + 1])), ids[first[a] : first[b]]
        good += np.bincount(part[owner], minlength=SIZE)
        bad += np.bincount(part[~owner], minlength=SIZE)
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(ids, first, y, ratio, rows, cost=1.0, epochs=12, tolerance=1e-3, seed=7):
    """Weights and intercept of the L1-loss linear SVM over ``rows``, by dual coordinate descent.

    Rows are the ratio-scaled indicators at unit length, with a constant 1 for the intercept.
    """
    weight, intercept, dual = np.zeros(SIZE), 0.0, np.zeros(len(y))
    value, norm = ratio.astype(np.float32)[ids], np.ones(len(y))
    for a, b in _pieces(len(y)):
        part, inside = value[first[a] : first[b]], first[a : b + 1] - first[a]
        size = np.maximum(np.sqrt(segment_sum(part.astype(np.float64) ** 2, inside)), 1e-12)
        part /= np.repeat(size, np.diff(inside)).astype(np.float32)
        norm[a:b] += segment_sum(part.astype(np.float64) ** 2, inside)
    order, rng, ends = np.array(rows), np.random.default_rng(seed), first.tolist()
    for _ in range(epochs):
        rng.shuffle(order)
        widest = 0.0
        for r in order.tolist():
            i, x = ids[ends[r] : ends[r + 1]], value[ends[r] : ends[r + 1]]
            gradient = y[r] * (weight[i] @ x + intercept) - 1
            ahead = min(max(dual[r] - gradient / norm[r], 0.0), cost)
            step = (ahead - dual[r]) * y[r]
            widest = max(widest, abs(step))
            if step:
                dual[r] = ahead
                weight[i] += step * x
                intercept += step
        if widest < tolerance:
            break
    return weight, intercept


def margins(ids, first, ratio, weight, intercept) -> np.ndarray:
    out, both = np.zeros(len(first) - 1), ratio * weight
    for a, b in _pieces(len(out)):
        part, inside = ids[first[a] : first[b]], first[a : b + 1] - first[a]
        size = np.sqrt(segment_sum(ratio[part].astype(np.float64) ** 2, inside))
        out[a:b] = segment_sum(both[part].astype(np.float64), inside) / np.maximum(size, 1e-12)
    return out + intercept


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps on softened targets."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, np.log((good + 1) / (bad + 1))
    for _ in range(steps):
        p = sigmoid(slope * margin + offset)
        g, h = p - target, p * (1 - p) + 1e-9
        matrix = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(matrix, [(g * margin).sum(), g.sum()])
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def _constant(share: float) -> dict:
    return {"weight": np.zeros(SIZE, np.float32), "ratio": np.zeros(SIZE, np.float32), "intercept": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}


def _fit(rows: pa.Table, cost: float) -> dict:
    y = np.where(rows["label"].to_numpy() == 1, 1, -1)
    if abs(y.sum()) == len(y):
        return _constant((np.sum(y > 0) + 1) / (len(y) + 2))
    data, at = textvec.text_buffer(rows["ids"].combine_chunks())
    ids, first = data.view(np.int32), at // 4
    ratio = log_count_ratio(ids, first, y)
    outside = np.zeros(len(y))
    for part in (0, 1):
        mine, other = np.flatnonzero(np.arange(len(y)) % 2 == part), np.flatnonzero(np.arange(len(y)) % 2 != part)
        outside[other] = margins(ids, first, ratio, *dual_coordinate_descent(ids, first, y, ratio, mine, cost))[other]
    slope, offset = platt(outside, y)
    weight, intercept = dual_coordinate_descent(ids, first, y, ratio, np.arange(len(y)), cost)
    return {"weight": weight.astype(np.float32), "ratio": ratio.astype(np.float32), "intercept": intercept, "slope": slope, "offset": offset}


def fit(sample: DataFrame, cost: float = 1.0) -> dict:
    """The model, from ``sample(doc_id, text, label)``, a bounded number of rows, fitted by one task."""

    def task(batches):
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                ids, first = features(rows.column("text"))
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64) * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), cells.cast(pa.binary())], ["doc_id", "label", "ids"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(task, "doc_id long, label int, ids binary")
    return in_one_task(rows, sample_order(), "ids", SAMPLE_BYTES, partial(_fit, cost=cost)) or _constant(0.5)


def score(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with column ``name``, the score (0 to 1, higher is better) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = own_names(keep)
    text = inner[keep.index("text")] if "text" in keep else "_text"
    chosen = docs.select(*renamed(docs, keep, inner), *([] if "text" in keep else [F.col("text").alias(text)]))
    schema = chosen.select(*inner).schema.add("_score", "double")

    def task(batches):
        m = shared.value
        for batch in batches:
            for rows in textvec.slices(batch, text):
                ids, first = features(rows.column(text))
                p = sigmoid(m["slope"] * margins(ids, first, m["ratio"], m["weight"], m["intercept"]) + m["offset"])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in inner), pa.array(p)], [*inner, "_score"])

    return chosen.mapInArrow(task, schema).select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), F.col("_score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, fit(training_sample(docs, labels, "quality", sample_rows)), keep)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents that the classifier does not reject, with their own columns."""
    model = fit(training_sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE_ROWS))
    return score(docs, model, docs.columns, "_quality").where(F.col("_quality") >= threshold).drop("_quality")
