"""Language-model scores: a log-bilinear model over word classes, trained with noise-contrastive estimation.

Tokens are words (``A-Z`` lower-cased) and one end for each document.  The
``HEAD`` most frequent training tokens are classes of their own; all other words
fall into ``TAILS`` classes by their last two bytes.  The model predicts a class
from the two before it, q = d1 * r[c1] + d2 * r[c2], score q.r[c] + b[c]; within
a tail class a word has its smoothed unigram share.  As the score is a sum over
the context's two places, the normaliser of every context is one matrix product
of two exponentiated tables, so each token's log-probability is exactly normalised.

1. Counts of all words of all training documents, combined map-side and summed
   by Spark.  The table grows with the corpus and never leaves the cluster.
2. Training: every task walks through its documents (``LEAST`` tokens or more,
   on average) from the same start and takes gradient steps on one in ``EVERY``
   positions of each; the parameters are averaged, weighted by positions.  The
   rounds together take every position once.  It does not matter which worker
   runs which task, nor how often.
3. Scoring: the at most ``FREQUENT`` most frequent words' counts are broadcast;
   the other words' occurrences, a small part, meet their counts in a join.

Cases: a null or empty text is one token, the end.  Words that no training
document has count as unknown.  Without training documents all counts are 0.
Rows are scored one by one, so null and repeated identifiers do no harm.  Empty
tables give an empty result.  Extra columns do not matter.
"""

from __future__ import annotations

from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelattice.llm import textvec
from sitelattice.llm.runtime import Scratch, fold, own_names, renamed, segment_sum, table

HEAD, TAILS = 1024, 64
BOS = HEAD + TAILS  # only as context
EVERY = 3
DIM, ROUNDS, BATCH, NOISE, RATE = 48, EVERY, 512, 96, 0.1  # a round for each remainder, so every position is a target once
FREQUENT = 500_000
ALPHA = 0.1
#: Tokens that a training task has on average, at least: smaller partitions are merged, as the mean of many short walks stays near their start.
LEAST = 1_000_000
#: Pieces that the parameters are averaged in.
PIECES = 64
#: Distinct words that a task holds before it hands its counts on.
HOLD = 1_000_000

END = np.uint64(0x5851F42D4C957F2D)


def _tokens(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of the tokens of all rows end to end, ends included; each row's first token."""
    words = textvec.words(rows.column("text"))
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    value, tail = np.full(first[-1], END), np.zeros(first[-1], np.uint8)
    place = np.arange(len(words.start)) + words.doc
    value[place] = words.hash
    last = words.data[words.end - 1].astype(np.uint64) << np.uint64(8) | words.data[np.maximum(words.end - 2, words.start)]
    tail[place] = textvec.mix(last, 77) % np.uint64(TAILS)
    return value, tail, first


def count_words(train: DataFrame) -> DataFrame:
    """(word hash, tail class, n) of all tokens."""

    def merged(held):
        word, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([h[2] for h in held]), len(word)).astype(np.int64)
        tail = np.zeros(len(word), np.uint8)
        tail[at] = np.concatenate([h[1] for h in held])
        return word, tail, n

    def rows_of(word, tail, n):
        for i in range(0, len(word), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[i : i + 100_000].view(np.int64)), pa.array(tail[i : i + 100_000].astype(np.int32)), pa.array(n[i : i + 100_000])], ["word", "tail", "n"])

    def task(batches):
        held, size = [], 0
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                value, tail, _ = _tokens(rows)
                word, at, n = np.unique(value, return_index=True, return_counts=True)
                held.append((word, tail[at], n))
                size += len(word)
                if size > 2 * HOLD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HOLD:
                        yield from rows_of(*held[0])
                        held, size = [], 0
        if held:
            yield from rows_of(*merged(held))

    counted = train.select("text").mapInArrow(task, "word long, tail int, n long")
    return counted.groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int):
    """Words with the highest counts, at most ``most`` of them: a cut by count first, so nothing is ordered as a whole."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(100_000).toArrow()
    kept = np.cumsum(sizes["words"].to_numpy()) <= most
    if not kept.any():
        return None
    least = int(sizes["n"].to_numpy()[kept][-1])
    found = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    word, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(word)
    return word[order], n[order]


def class_of(value: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Class numbers; ``head`` has the head words' hashes, sorted."""
    if not len(head):
        return HEAD + tail.astype(np.int64)
    word, at = np.unique(value, return_inverse=True)
    place = np.minimum(np.searchsorted(head, word), len(head) - 1)
    place[head[place] != word] = -1
    place = place[at]
    return np.where(place >= 0, place, HEAD + tail.astype(np.int64))


def _contexts(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token."""
    one, two = np.full(len(classes), BOS), np.full(len(classes), BOS)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    start = first[:-1]
    one[start] = BOS
    two[start] = BOS
    second = start[np.diff(first) > 1] + 1
    two[second] = BOS
    return one, two


class LogBilinear:
    """Parameters and their gradient steps (AdaGrad) for the noise-contrastive loss."""

    NAMES = ("r", "b", "d")

    def __init__(self, share: np.ndarray, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.share = share  # of each class among the training tokens: the noise
        self.r = rng.normal(0, 0.1, (BOS + 1, DIM)).astype(np.float32)
        self.d = np.array([[1.0], [0.5]], np.float32) * np.ones((2, DIM), np.float32)
        self.b = np.log(np.maximum(share, 1e-9)).astype(np.float32)
        self.reset()

    def reset(self) -> None:
        self.speed = {n: np.full_like(getattr(self, n), 1e-2) for n in self.NAMES}
        self.log_noise = np.log(np.maximum(self.share, 1e-12) * NOISE).astype(np.float32)

    def _move(self, name: str, gradient: np.ndarray, rows=None) -> None:
        value, speed = getattr(self, name), self.speed[name]
        if rows is None:
            speed += gradient**2
            value += RATE * gradient / np.sqrt(speed)
        else:
            so_far = speed.take(rows, 0)
            so_far += gradient**2
            speed[rows] = so_far
            value[rows] += RATE * gradient / np.sqrt(so_far)

    def step(self, one, two, target, noise) -> None:
        where = np.concatenate([one, two, target, noise]).astype(np.uint16)  # sorted by radix
        size, vectors = len(target), self.r.take(where, 0)
        ra, rb, rt, rn = np.split(vectors, [size, 2 * size, 3 * size])
        q, lead = self.d[0] * ra + self.d[1] * rb, self.b - self.log_noise
        right = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, rt) + lead[target]))  # one minus the chance of data
        wrong = q @ -rn.T
        wrong -= lead[noise]
        np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(-1, wrong, out=wrong)
        gq = right[:, None] * rt + wrong @ rn
        gd = np.stack([np.einsum("ij,ij->j", gq, ra), np.einsum("ij,ij->j", gq, rb)])
        gradient = vectors  # in its place
        for part, value in zip((ra, rb, rt, rn), (gq * self.d[0], gq * self.d[1], right[:, None] * q, wrong.T @ q)):
            part[:] = value
        order = np.argsort(where, kind="stable")
        ordered = where.take(order)
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        pairs = gradient.take(order, 0).view(np.complex64)  # two float32 to a number: half as many sums
        self._move("r", np.add.reduceat(pairs, at, axis=0).view(np.float32) / size, ordered[at])
        gb = np.bincount(target, right, BOS) + np.bincount(noise, wrong.sum(0), BOS)
        self._move("b", (gb / size).astype(np.float32))
        self._move("d", (gd / size).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(BOS + 1, BOS) log10 scores of a class given the class one before, without the bias' share of
        the other place, and (BOS + 1, BOS + 1) log10 normalisers; the first stacked for both places."""
        one, two = (self.d[0] * self.r) @ self.r[:BOS].T + self.b, (self.d[1] * self.r) @ self.r[:BOS].T
        top_one, top_two = one.max(1, keepdims=True), two.max(1, keepdims=True)
        norm = np.log(np.exp(one - top_one).astype(np.float64) @ np.exp(two - top_two).astype(np.float64).T) + top_one + top_two.T
        ten = np.log(10)
        return np.stack([one, two]) / np.float32(ten), (norm / ten).astype(np.float32)


def positions(first: np.ndarray, turn: int) -> np.ndarray:
    """The tokens that a round takes: one in ``EVERY`` of each document, counted from its start."""
    at = np.arange(first[-1])
    return at[(at - np.repeat(first[:-1], np.diff(first))) % EVERY == turn % EVERY]


def _train_round(train: DataFrame, model: LogBilinear, head: np.ndarray, turn: int, scratch: Scratch) -> None:
    """One pass: every task's own steps from the model's parameters, then their weighted mean."""
    given = train.sparkSession.sparkContext.broadcast((model, head))

    def rows_of(parts):
        name, piece = zip(*parts)
        seen, part = zip(*parts.values())
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(piece, pa.int32()), pa.array(seen), pa.array([p.tobytes() for p in part], pa.binary())], ["name", "piece", "seen", "part"])

    def task(batches):
        model, head = deepcopy(given.value)  # a worker keeps what is broadcast for its next task
        model.reset()
        rng, seen = np.random.default_rng(turn), 0
        cumulative = np.cumsum(model.share)
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                value, tail, first = _tokens(rows)
                classes = class_of(value, tail, head)
                one, two = _contexts(classes, first)
                chosen = rng.permutation(positions(first, turn))
                for i in range(0, len(chosen), BATCH):
                    at = chosen[i : i + BATCH]
                    noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), BOS - 1)
                    model.step(one[at], two[at], classes[at], noise)
                seen += len(chosen)
        if seen:
            for name in model.NAMES:
                pieces = np.array_split(getattr(model, name).astype(np.float64).ravel() * seen, PIECES)
                yield rows_of({(name, k): (seen, piece) for k, piece in enumerate(pieces)})

    def add(batches):
        total = {}
        for batch in batches:
            for name, piece, seen, cell in zip(*(batch.column(c).to_pylist() for c in ("name", "piece", "seen", "part"))):
                n, value = total.get((name, piece), (0, 0.0))
                total[name, piece] = n + seen, value + np.frombuffer(cell)
        if total:
            yield rows_of(total)

    schema = "name string, piece int, seen long, part binary"
    parts = train.select("text").mapInArrow(task, schema).repartition(PIECES, "piece").mapInArrow(add, schema)
    found = sorted(parts.collect(), key=lambda r: r.piece)  # PIECES rows for each kind of parameters
    for name in {r.name for r in found}:
        mean = np.concatenate([np.frombuffer(r.part) / r.seen for r in found if r.name == name])
        setattr(model, name, mean.reshape(getattr(model, name).shape).astype(np.float32))


def fit(train: DataFrame, scratch: Scratch) -> dict:
    counts = scratch.keep(count_words(train), "counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    frequent = _most_frequent(counts, FREQUENT)
    words, n = frequent or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n").toArrow()  # HEAD rows, without a sort of the whole
    head, head_n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    head, head_n = head[np.argsort(head)], head_n[np.argsort(head)]
    more = ~np.isin(head, words)  # where a very large number of words have one count
    words, n = np.concatenate([words, head[more]]), np.concatenate([n, head_n[more]])
    words, n = words[np.argsort(words)], n[np.argsort(words)]
    tails = counts.where(~F.col("word").isin(head.view(np.int64).tolist())) if len(head) else counts
    tails = tails.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # TAILS rows
    in_tail = np.zeros((2, TAILS))
    for row in tails:
        in_tail[:, row.tail] = row.n, row.words
    share = np.zeros(BOS)
    share[: len(head)] = head_n
    share[HEAD:] = in_tail[0] + ALPHA
    model = LogBilinear(share / share.sum())
    if total:
        merged = train.coalesce(max(total // LEAST, 1))
        for turn in range(ROUNDS):
            _train_round(merged, model, head, turn, scratch)
    return {"counts": counts, "total": total or 0, "distinct": distinct, "words": words, "n": n, "head": head, "in_tail": in_tail, "tables": model.tables()}


def score(docs: DataFrame, model: dict, scratch: Scratch, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score of each row."""
    below = model["total"] + ALPHA * (model["distinct"] + 1)
    within = model["in_tail"][0] + ALPHA * (model["in_tail"][1] + 1)
    given = docs.sparkSession.sparkContext.broadcast((model["words"], model["n"], model["head"], within, model["tables"]))
    inner = own_names(keep)
    chosen = docs.select(*renamed(docs, keep, inner), "text")
    schema = chosen.select(*inner).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("neural", "double"), ("word", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType())), ("tail", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)

    def task(batches):
        words, n, head, within, (score_table, norm) = given.value
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                value, tail, first = _tokens(rows)
                classes = class_of(value, tail, head)
                one, two = _contexts(classes, first)
                neural = score_table[0, one, classes] + score_table[1, two, classes] - norm[one, two]
                distinct, at = np.unique(value, return_inverse=True)
                place = np.minimum(np.searchsorted(words, distinct), max(len(words) - 1, 0))
                found = words[place] == distinct if len(words) else np.zeros(len(distinct), bool)
                count = np.where(found, n[place] if len(n) else 0, 0)
                base = np.log10((count + ALPHA) / below)[at]
                own = np.where(classes >= HEAD, np.log10((count[at] + ALPHA) / within[np.maximum(classes - HEAD, 0)]), 0.0)
                known = found[at]
                base, own = np.where(known, base, 0.0), np.where(known, own, 0.0)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((value[rare], owner[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (value[order][1:] != value[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                lead = np.flatnonzero(new)
                times = np.diff(np.append(lead, len(order))).astype(np.int32)
                lead = order[lead]
                offsets = pa.array(np.searchsorted(owner[lead], np.arange(len(first))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (value[lead].view(np.int64), times, tail[lead].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([
                    *(rows.column(c) for c in inner), pa.array(np.diff(first)), pa.array(segment_sum(known.astype(np.int64), first)),
                    pa.array(segment_sum(base, first)), pa.array(segment_sum(neural.astype(np.float64) + own, first)), *lists,
                ], schema.names)

    partial = scratch.keep(chosen.mapInArrow(task, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = partial.select("_row", F.explode(F.arrays_zip("word", "times", "tail")).alias("w")).select("_row", "w.word", "w.times", "w.tail")
    counts = model["counts"].select("word", F.col("n").alias("c"))
    share = F.array(*(F.lit(float(x)) for x in within))[F.col("tail")]
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / below)).alias("base_rest"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / share)).alias("own_rest"),
    )
    out = partial.drop("word", "times", "tail").join(rare, "_row", "left")
    rest = lambda name: F.coalesce(name, F.lit(0))
    return out.select(
        *(F.col(i).alias(k) for i, k in zip(inner, keep)), "n_tokens", (F.col("n_known") + rest("known")).alias("n_known"), F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + rest("base_rest")).alias("base_score"), (F.col("neural") + rest("own_rest")).alias("score"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "language-model")
    model = fit(docs.where(fold("doc_id", 10) != 0), scratch)
    out = score(docs, model, scratch, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
