"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Dense features of a whole text: densities of a base lexicon and of a lexicon
learned from the training sample, of word stems learned there (insults in
languages that the base lexicon lacks, in any inflection), the same after undoing look-alike characters
(obfuscation), lexicon words near second-person words, capitals, punctuation,
symbols and repeated characters.  Trees are grown on histograms in numpy; the
isotonic curve is fitted on out-of-fold scores.

The fit reads at most ``sample_rows`` labelled rows of the training fold, and
``SAMPLE_BYTES`` of their texts, documented bounds; one task on an executor fits it.
Scoring covers every whole text in one pass without a shuffle.

Cases: a null text scores as an empty one.  Without labelled rows every score
is 0.5; with labels of one class it is that class's smoothed share.  Repeated
rows and extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm import textvec
from sitelattice.llm.labels import held_out, sample_order, training_sample
from sitelattice.llm.runtime import in_one_task, own_names, renamed, sigmoid, table

#: Labelled rows, and bytes of their texts, that a fit reads at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 128 << 20
#: Words that insult in everyday English, known before any training.
LEXICON = ("idiot", "stupid", "moron", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting", "dumb", "ugly", "hate", "jerk", "fool", "garbage", "creep", "freak", "pig", "filthy", "vile", "useless", "crap", "damn", "hell", "suck", "sucks", "kill", "shut", "imbecile")
SECOND_PERSON = ("you", "your", "yours", "yourself", "youre", "u", "ur")
LOOK_ALIKES = bytes.maketrans(b"0134578@$!|", b"oieastbasil")
LEARNED_WORDS = 256
#: Lengths in bytes of the word beginnings that count as stems.
STEMS = (4, 5, 6, 7, 8)
NEAR = 5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.isin(np.arange(256), [ord("!"), ord("?")])


def hashes_of(items) -> np.ndarray:
    return np.unique(textvec.words(pa.array([" ".join(items)])).hash)


def _letters_only(data: np.ndarray, at: np.ndarray, undo: bool) -> textvec.Words:
    """Words after look-alikes are undone, if asked, and everything else but letters and white space is removed."""
    if undo:
        data = np.frombuffer(data.tobytes().translate(LOOK_ALIKES), np.uint8)
    keep = ~(_MARK | _DIGIT)[data]
    place = np.concatenate([[0], np.cumsum(keep)])
    return textvec.split(data[keep], place[at])


def _member(value: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in a small sorted set; a table of the low 16 bits answers most at once."""
    if not len(sorted_set):
        return np.zeros(len(value), bool)
    table = np.zeros(1 << 16, bool)
    table[(sorted_set & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = table[(value & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = sorted_set[np.minimum(np.searchsorted(sorted_set, value[at]), len(sorted_set) - 1)] == value[at]
    return out


def _per_doc(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def stem_hashes(words: textvec.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first n <= 8 bytes of each longer word, and the words' numbers."""
    eight = np.ndarray((len(words.data) + 1,), "<u8", words.padded, 0, (1,))
    longer = np.flatnonzero(words.end - words.start > n)
    return textvec.mix(eight[words.start[longer]] & np.uint64((1 << 8 * n) - 1), 900 + n), longer


def _vocabulary(words: textvec.Words) -> list[tuple[bytes, bytes]]:
    """For each document: its distinct words, and the stems that begin two of its words or more."""
    parts = [stem_hashes(words, n) for n in STEMS]
    value, owner = np.concatenate([v for v, _ in parts]), words.doc[np.concatenate([w for _, w in parts])]
    order = np.argsort(owner, kind="stable")
    value, first = value[order], np.searchsorted(owner[order], np.arange(len(words.at)))
    out = []
    for a, b, c, d in zip(words.first[:-1], words.first[1:], first[:-1], first[1:]):
        stems, count = np.unique(value[c:d], return_counts=True)
        out.append((np.unique(words.hash[a:b]).tobytes(), stems[count > 1].tobytes()))
    return out


def features(column: pa.Array, base: np.ndarray, learned: np.ndarray, stems: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, textvec.Words]:
    """(rows, 18) dense features, and the words that the lexicons are matched with."""
    data, at = textvec.text_buffer(column)
    plain, undone = _letters_only(data, at, False), _letters_only(data, at, True)
    n = np.maximum(np.diff(plain.first), 1)
    in_base, in_learned, in_undone = _member(plain.hash, base), _member(plain.hash, learned), _member(undone.hash, base)
    in_stems = np.zeros(len(plain.start), bool)
    for length in STEMS:
        value, longer = stem_hashes(plain, length)
        in_stems[longer[_member(value, stems)]] = True
    person = np.flatnonzero(_member(plain.hash, second))
    hit = np.flatnonzero(in_base | in_learned | in_stems)
    near = np.zeros(len(plain.start), bool)
    for side in (-1, 0):
        other = person[np.clip(np.searchsorted(person, hit) + side, 0, max(len(person) - 1, 0))] if len(person) else np.zeros(0, np.int64)
        if len(other):
            near[hit[(abs(other - hit) <= NEAR) & (plain.doc[other] == plain.doc[hit])]] = True
    letters, upper, digits, marks = (np.maximum(_per_doc(t[data], at), 0) for t in (_LETTER, _UPPER, _DIGIT, _MARK))
    size = np.maximum(np.diff(at), 1)
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    stem_n = _per_doc(in_stems, plain.first)
    base_n, learned_n, undone_n = _per_doc(in_base, plain.first), _per_doc(in_learned, plain.first), _per_doc(in_undone, undone.first)
    return np.stack([
        base_n / n, np.log1p(base_n), learned_n / n, np.log1p(learned_n),
        np.maximum(undone_n - base_n, 0) / n, np.log1p(np.maximum(undone_n - base_n, 0)),
        _per_doc(near, plain.first) / n, np.log1p(_per_doc(near, plain.first)), np.bincount(plain.doc[person], minlength=len(n)) / n,
        upper / np.maximum(letters, 1), _per_doc(_STOP[data], at) / size, marks / size, digits / size, letters / size,
        _per_doc(same, at) / size, np.log1p(np.diff(plain.first)), stem_n / n, np.log1p(stem_n),
    ], 1), plain


def learn_lexicon(cells: list[np.ndarray], y: np.ndarray, most: int = LEARNED_WORDS, support: int = 8, odds: float = 2.5) -> np.ndarray:
    """Hashes of the words whose presence speaks most clearly for label 1."""
    if not y.any() or y.all():
        return np.zeros(0, np.uint64)
    words, where = np.unique(np.concatenate(cells), return_inverse=True)
    label = np.repeat(y, [len(c) for c in cells])
    bad, all_ = np.bincount(where, weights=label, minlength=len(words)), np.bincount(where, minlength=len(words))
    ratio = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((all_ - bad + 0.5) / ((1 - y).sum() + 1))
    good = np.flatnonzero((bad >= support) & (ratio >= odds))
    return np.sort(words[good[np.argsort(-ratio[good], kind="stable")[:most]]])


class Trees:
    """Boosted regression trees for the logistic loss, of fixed depth, on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, damping: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.damping = rounds, depth, rate, bins, damping

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(prior / (1 - prior))), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = sigmoid(f)
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            inner, leaf_of = (1 << self.depth) - 1, np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins + 1)
            for level in range(self.depth):
                for node in range((1 << level) - 1, (2 << level) - 1):
                    rows = np.flatnonzero(leaf_of == node)
                    best = 1e-9
                    for j in range(x.shape[1]):
                        sg = np.cumsum(np.bincount(binned[rows, j], g[rows], self.bins + 1))
                        sh = np.cumsum(np.bincount(binned[rows, j], h[rows], self.bins + 1))
                        gain = sg**2 / (sh + self.damping) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + self.damping) - sg[-1] ** 2 / (sh[-1] + self.damping)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[node], cut[node] = gain[k], j, k
                    right = binned[rows, feature[node]] > cut[node]
                    leaf_of[rows] = 2 * node + 1 + right
            leaf = leaf_of - inner
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.damping)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        f = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve through (margin, y): pools of adjacent violators, equal margins as one."""
    level, where = np.unique(margin, return_inverse=True)
    rows = np.bincount(where, minlength=len(level)).astype(float)
    pools: list[list[float]] = []  # mean, rows, lowest and highest margin
    for m, n, t in zip(level.tolist(), rows.tolist(), np.bincount(where, y, len(level)).tolist()):
        pools.append([t / n, n, m, m])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, n, _, high = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + mean * n) / (last[1] + n)
            last[1] += n
            last[3] = high
    at = np.array([v for p in pools for v in (p[2], p[3])])
    return at, np.array([p[0] for p in pools for _ in range(2)])


def fit(sample: DataFrame) -> dict:
    """The model, from ``sample(doc_id, text, label)``, a bounded number of rows, fitted by one task."""

    def task(batches):
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                plain = _letters_only(*textvec.text_buffer(rows.column("text")), False)
                cells = [pa.array(c, pa.binary()) for c in zip(*_vocabulary(plain))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), rows.column("text").cast(pa.string()), *cells], ["doc_id", "label", "text", "words", "stems"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(task, "doc_id long, label int, text string, words binary, stems binary")
    model = in_one_task(rows, sample_order(), "text", SAMPLE_BYTES, _fit)
    return model or {"trees": None, "share": 0.5}


def _fit(rows: pa.Table) -> dict:
    base, second = hashes_of(LEXICON), hashes_of(SECOND_PERSON)
    y = rows["label"].to_numpy().astype(np.float64)
    model = {"base": base, "second": second, "trees": None, "share": (y.sum() + 1) / (len(y) + 2)}
    if not y.any() or y.all():
        return model
    cells, stem_cells = ([np.frombuffer(c, np.uint64) for c in rows[name].to_pylist()] for name in ("words", "stems"))
    text, part, outside = rows["text"].combine_chunks(), np.arange(len(y)) % 3, np.zeros(len(y))

    def dense(learned, stems):
        return np.concatenate([features(b.column("text"), base, learned, stems, second)[0] for b in textvec.slices(pa.RecordBatch.from_arrays([text], ["text"]), "text")])

    for k in range(3):  # the learned lexicon, too, is blind to the fold that it is calibrated on
        own = np.flatnonzero(part != k)
        x = dense(*(learn_lexicon([c[i] for i in own], y[own]) for c in (cells, stem_cells)))
        outside[part == k] = Trees().fit(x[own], y[own]).margin(x[part == k])
    model["learned"], model["stems"] = learn_lexicon(cells, y), learn_lexicon(stem_cells, y)
    model["trees"] = Trees().fit(dense(model["learned"], model["stems"]), y)
    model["knots"] = isotonic(outside, y)
    return model


def score(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` with column ``name``, the toxicity (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = own_names(keep)
    chosen = docs.select(*renamed(docs, keep, inner), "text")
    schema = chosen.select(*inner).schema.add("_score", "double")

    def task(batches):
        m = shared.value
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                if m["trees"] is None:
                    p = np.full(rows.num_rows, m["share"])
                else:
                    x, _ = features(rows.column("text"), m["base"], m["learned"], m["stems"], m["second"])
                    p = np.interp(m["trees"].margin(x), *m["knots"])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in inner), pa.array(p.astype(np.float64))], [*inner, "_score"])

    return chosen.mapInArrow(task, schema).select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), F.col("_score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, fit(training_sample(docs, labels, "toxic", sample_rows)), keep)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
