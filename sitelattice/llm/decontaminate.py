"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``2 * HALF`` words, starting every ``HALF`` words, over
every whole document.  Three passes read the documents; none shuffles a text.

1. Document frequencies of hashed words, over all passages.
2. A randomised SVD of the TF-IDF matrix A of all passages.  Each task adds up its rows' part of A'(A omega)
   for a random omega of ``RANK + EXTRA`` columns; the parts are summed by blocks
   of features, and the Nystroem formula turns the sum, of fixed size, into the
   leading right singular vectors and values.
3. Each passage is folded into the latent space and compared with the benchmark's
   passages by cosine, as one matrix product for a slice of text.  Candidates that
   share too few rare words are dropped; for the others the longest common
   subsequence with the whole benchmark item is found around the passage, and its
   share of the item and of the item's answer (its last words) decides.

The benchmark is the query set, held by every task.  It is broadcast in blocks
of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters (or one item),
whatever its size; each block is a pass over the documents, the model is fitted once.

Cases: case, punctuation and white space do not matter.  Null and empty texts
match nothing, nor do items without words.  Items of fewer than ``EXACT_BELOW``
words must appear word for word.  Repeated documents and items are each
reported.  Filtering judges each row by its own text, so null and repeated
identifiers do no harm.  Empty tables give an empty result.  Extra columns do not
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm import textvec
from sitelattice.llm.runtime import own_names, renamed, table

HALF = 16
BITS = 14
RANK, EXTRA = 64, 8
#: Of 911 edited copies that brute force accepts, 910 are found at 0.15, 906 at 0.2 and 903 at 0.25 (sf0.1, 62 and 70 % of the words kept).
COSINE = 0.15
#: Share of a passage's rare words (by hash) that a candidate must have; of all its words, if it has few rare ones.
RARE_SHARE, SHARE, FEW = 0.3, 0.45, 4
#: A word is rare if at most this share of the passages have it.
RARE = 0.01
#: Share of an item's words in common order from which a passage is a copy; the same where the answer is there too.
COPY, PARAPHRASE, ANSWER = 0.75, 0.6, 0.7
EXACT_BELOW = 6
BLOCK_ITEMS, BLOCK_CHARS = 4096, 1 << 24
BLOCKS = 64
#: Tasks of the pass that hands on a matrix each, at most.
MATRICES = 4096
_MARKS = 512


def _halves(words: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each half window, with the end after the last; the document of each."""
    count = -(-np.diff(words.first) // HALF)
    doc = np.repeat(np.arange(len(count)), count)
    start = words.first[doc] + HALF * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return np.append(start, len(words.start)), doc


def _by_half(feature: np.ndarray, start: np.ndarray, other: int) -> np.ndarray:
    """The features of each half window side by side, ``other`` behind a short half's end."""
    place = start[:-1, None] + np.arange(HALF)
    return np.where(place < start[1:, None], feature[np.minimum(place, len(feature) - 1)], feature.dtype.type(other))


def _sums(table: np.ndarray, feature: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each half window the sum of its words' rows of a table."""
    table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])  # for places behind a short half's end
    row = _by_half(feature, start, len(table) - 1)
    out = table[row[:, 0]]
    for k in range(1, HALF):
        out += table[row[:, k]]
    return out


def _feature(words: textvec.Words) -> np.ndarray:
    return (words.hash & np.uint64((1 << BITS) - 1)).astype(np.int64)


def passage_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many half windows each hashed word is, and how many there are."""

    def task(batches):
        total, passages = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                words = textvec.plain_words(rows.column("text"))
                start, _ = _halves(words)
                if not len(words.start):
                    continue
                feature = np.sort(_by_half(_feature(words).astype(np.int16), start, 1 << BITS), axis=1)
                new = np.ones(feature.shape, bool)
                new[:, 1:] = feature[:, 1:] != feature[:, :-1]
                total += np.bincount(feature[new], minlength=(1 << BITS) + 1)[:-1]
                passages += len(start) - 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], passages))], ["feature", "n"])

    found = docs.select("text").mapInArrow(task, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # 2 ** BITS + 1 rows
    out, feature = np.zeros((1 << BITS) + 1, np.int64), found["feature"].to_numpy()
    out[feature] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def _rows_of(batches):
    """Sums of the blocks' matrices in a partition, as (block, matrix) rows."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cell in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
            part = np.frombuffer(cell, np.float32).astype(np.float64)
            total[block] = total[block] + part if block in total else part
    for block, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])


def fit_space(docs: DataFrame, idf: np.ndarray, seed: int = 2011) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and singular values of the passages' TF-IDF matrix."""
    omega = np.random.default_rng(seed).standard_normal((1 << BITS, RANK + EXTRA)).astype(np.float32)
    given = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), omega))

    def task(batches):
        idf, omega = given.value
        weighted = omega * idf[:, None]
        total = np.zeros(omega.shape[::-1], np.float64)
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                words = textvec.plain_words(rows.column("text"))
                if not len(words.start):
                    continue
                feature, (start, _) = _feature(words), _halves(words)
                size = np.diff(start)
                norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), idf[feature] ** 2))
                image = _sums(weighted, feature, start) / np.maximum(norm, 1e-6)[:, None] ** 2
                for column, out in zip(np.ascontiguousarray(image.T, np.float64), total):
                    out += np.bincount(feature, np.repeat(column, size), len(out))
        total = np.ascontiguousarray(total.T) * idf[:, None]
        for k, part in enumerate(np.split(total, BLOCKS)) if total.any() else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["block", "part"])

    schema = "block int, part binary"
    summed = docs.select("text").coalesce(MATRICES).mapInArrow(task, schema).repartition(BLOCKS, "block").mapInArrow(_rows_of, schema).toArrow().sort_by("block")
    image = np.zeros((BLOCKS, (1 << BITS) // BLOCKS * (RANK + EXTRA)))
    for block, part in zip(summed["block"].to_pylist(), summed["part"].to_pylist()):
        image[block] = np.frombuffer(part, np.float64)
    image = image.reshape(1 << BITS, RANK + EXTRA)
    omega = omega.astype(np.float64)
    shift = 1e-7 * max(np.linalg.norm(image), 1e-12)
    image += shift * omega
    middle = omega.T @ image
    factor = np.linalg.cholesky((middle + middle.T) / 2 + 1e-9 * np.trace(middle) / len(middle) * np.eye(len(middle)))
    vectors, root, _ = np.linalg.svd(np.linalg.solve(factor, image.T).T, full_matrices=False)
    return vectors[:, :RANK], np.sqrt(np.maximum(root[:RANK] ** 2 - shift, 0))


def fit(docs: DataFrame) -> dict:
    """The latent space: folding matrix (feature to latent) and which features are rare."""
    frequency, passages = passage_frequencies(docs)
    idf = np.log((passages + 1) / (frequency + 1)) + 1e-3
    vectors, values = fit_space(docs, idf)
    keep = values > 1e-6 * max(values[0], 1e-12) if len(values) else values > 0
    folding = vectors[:, keep] / values[keep] * idf[:, None] if keep.any() else idf[:, None]
    return {"folding": folding.astype(np.float32), "rare": frequency <= RARE * passages}


def _passages(words: textvec.Words, model: dict) -> dict:
    """Unit latent vectors, marks of rare words, then of all words, and first words of all passages."""
    start, doc = _halves(words)
    n = len(doc)
    feature = _feature(words)
    latent = _sums(model["folding"], feature, start)
    owner, rare = np.repeat(np.arange(n), np.diff(start)), model["rare"][feature]
    marks, bit = np.zeros((n, 2 * _MARKS), bool), (words.hash >> np.uint64(40)).astype(np.int64) % _MARKS
    marks[owner[rare], bit[rare]] = True
    marks[owner, bit + _MARKS] = True
    marks = np.packbits(marks, axis=1).view(np.uint64)
    with_next = np.flatnonzero(np.append(doc[1:] == doc[:-1], False))
    latent_, marks_ = latent.copy(), marks.copy()
    latent_[with_next] += latent[with_next + 1]
    marks_[with_next] |= marks[with_next + 1]
    lone = np.append(doc[1:] == doc[:-1], False) | ~np.append(False, doc[1:] == doc[:-1])  # a last half is part of the window before
    use = np.flatnonzero(lone)
    latent_ /= np.maximum(np.linalg.norm(latent_, axis=1, keepdims=True), 1e-12)
    return {"latent": latent_[use], "marks": marks_[use], "start": start[:-1][use], "doc": doc[use]}


def _places(item: np.ndarray, text: np.ndarray) -> list[int]:
    """For each word of the text the item's places that have it, as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    return [where.get(x, 0) for x in text.tolist()]


def _common(size: int, places: list[int]) -> int:
    full = (1 << size) - 1
    row = full
    for match in places:
        if match:
            up = row & match
            row = (row + up | row - up) & full
    return size - row.bit_count()


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays of word hashes, by bit-parallel rows."""
    return _common(len(item), _places(item, text))


def _tight(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Best (length, start) of the common subsequence with a stretch of the region little longer than the item.

    A stretch with no more words of the item than the best length so far cannot be better."""
    size, step = len(item) + max(len(item) // 4, 2), max(len(item) // 8, 1)
    places, best = _places(item, region), (0, 0)
    some = list(accumulate((match > 0 for match in places), initial=0))
    for at in range(0, max(len(region) - size + step, 1), step):
        if some[min(at + size, len(places))] - some[min(at, len(places))] > best[0]:
            best = max(best, (_common(len(item), places[at : at + size]), -at))
    return best[0], -best[1]


def _inside(item: np.ndarray, region: np.ndarray) -> bool:
    windows = np.lib.stride_tricks.sliding_window_view(region, len(item)) if len(region) >= len(item) else np.zeros((0, len(item)))
    return bool((windows == item).all(1).any())


def _queries(items: list[tuple[int, str]]) -> tuple[list[int], list[np.ndarray], pa.Array, np.ndarray]:
    """Identifiers and word hashes of the items; their passages (side by side, the last one up to its end) and whose they are."""
    words = textvec.plain_words(pa.array([t for _, t in items], pa.string()))
    texts = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    parts, owner = [], []
    for item, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        for start in sorted({*range(a, max(b - 2 * HALF, a), 2 * HALF), max(b - 2 * HALF, a)}) if b > a else ():
            parts.append(b" ".join(words.word(i) for i in range(start, min(start + 2 * HALF, b))))
            owner.append(item)
    return [i for i, _ in items], texts, pa.array(parts, pa.binary()), np.array(owner, np.int64)


class _Matcher:
    """What a task holds of a block of benchmark items: matches whole documents against them."""

    def __init__(self, block, model: dict):
        self.ids, self.texts, parts, self.owner = block
        self.model = model
        if len(parts):
            own = _passages(textvec.words(parts), model)
            self.latent, self.marks = np.ascontiguousarray(own["latent"].T), np.ascontiguousarray(own["marks"].T)
            self.parts = (slice(0, _MARKS // 64), slice(_MARKS // 64, None))
            rare, every = (np.bitwise_count(own["marks"][:, part]).sum(1) for part in self.parts)
            self.needs = np.where(rare >= FEW, np.ceil(RARE_SHARE * rare), 0), np.where(rare >= FEW, 0, np.ceil(SHARE * every))

    def found(self, column: pa.Array) -> list[tuple]:
        """(row, item_id, cosine, lcs, coverage, answer_coverage, start_word, end_word) of a slice's texts."""
        words = textvec.plain_words(column)
        if not len(self.owner) or not len(words.start):
            return []
        places, own = {}, _passages(words, self.model)
        mine = np.ascontiguousarray(own["marks"].T)
        for at in range(0, len(own["doc"]), 4096):
            cosine = (own["latent"][at : at + 4096] @ self.latent).ravel()
            near = np.flatnonzero(cosine >= COSINE)
            p, q = np.divmod(near, len(self.owner))
            for columns, need in zip(self.parts, self.needs):
                asked = need[q]
                both = np.zeros(len(p), np.uint8)
                for c in range(*columns.indices(len(mine))) if asked.any() else ():
                    both += np.bitwise_count(mine[c][at + p] & self.marks[c][q])
                ok = both >= asked
                near, p, q = near[ok], p[ok], q[ok]
            for p_, q_, c in zip((at + p).tolist(), q.tolist(), cosine[near].tolist()):
                places.setdefault((int(own["doc"][p_]), int(self.owner[q_])), []).append((c, int(own["start"][p_])))
        out = []
        for (doc, item), where in places.items():
            if best := _judge(self.texts[item], words.hash, words.first[doc], words.first[doc + 1], where):
                out.append((doc, self.ids[item], *best))
        return out


_FOUND = ("item_id", "cosine", "lcs", "coverage", "answer_coverage", "start_word", "end_word")


def search(docs: DataFrame, items: list[tuple[int, str]], model: dict) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, coverage, answer_coverage, start_word, end_word) of contaminated passages, best first for each pair."""
    shared = docs.sparkSession.sparkContext.broadcast((_queries(items), model))

    def task(batches):
        matcher = _Matcher(*shared.value)
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                if out := matcher.found(rows.column("text")):
                    row, *rest = zip(*out)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), *(pa.array(c) for c in rest)], ["doc_id", *_FOUND])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, item_id long, cosine double, lcs long, coverage double, answer_coverage double, start_word long, end_word long")


def without(docs: DataFrame, items: list[tuple[int, str]], model: dict) -> DataFrame:
    """The rows of ``docs`` whose text holds none of the items: each is judged where it stands, by its text alone."""
    inner = own_names(docs.columns)
    text = inner[docs.columns.index("text")]
    rows = docs.select(*renamed(docs, docs.columns, inner))
    shared = docs.sparkSession.sparkContext.broadcast((_queries(items), model))

    def task(batches):
        matcher = _Matcher(*shared.value)
        for batch in batches:
            for part in textvec.slices(batch, text):
                keep = np.ones(part.num_rows, bool)
                keep[[f[0] for f in matcher.found(part.column(text))]] = False
                if keep.any():
                    yield part if keep.all() else part.filter(pa.array(keep))

    return rows.mapInArrow(task, rows.schema).toDF(*docs.columns)


def _judge(item: np.ndarray, text: np.ndarray, low: int, high: int, places: list[tuple[float, int]]):
    """The best contaminated place of an item in a document, or None."""
    best, done = None, -1
    for cosine, start in sorted(places, key=lambda x: x[1]):
        a, b = max(start - len(item), low), min(start + 2 * HALF + len(item), high)
        if b <= done:
            continue
        done = b
        region = text[a:b]
        if len(item) < EXACT_BELOW:
            if not _inside(item, region):
                continue
            lcs, at, answer = len(item), 0, 1.0
        else:
            if common_subsequence(item, region) < PARAPHRASE * len(item):
                continue
            lcs, at = _tight(item, region)
            last = item[-max(3, len(item) // 5) :]
            answer = _tight(last, region)[0] / len(last)
        share = lcs / len(item)
        if share >= COPY or share >= PARAPHRASE and answer >= ANSWER:
            here = (cosine, lcs, share, answer, int(a - low + at), int(min(a + at + len(item) + len(item) // 4, b) - low))
            best = max(best, here, key=lambda x: (x[2], x[0])) if best else here
    return best


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded number and size, one of which is held at a time; at least one block."""
    block, size, some = [], 0, False
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r.text) > BLOCK_CHARS):
            yield block
            block, size, some = [], 0, True
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block or not some:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, model: dict | None = None) -> DataFrame:
    """Every (document, benchmark item) pair in which the document holds the item."""
    model = model or fit(docs)
    return reduce(DataFrame.union, (search(docs, block, model) for block in item_blocks(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    model = model or fit(docs)
    return reduce(lambda rows, block: without(rows, block, model), item_blocks(benchmark), docs)


def op2(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with their own columns."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
