"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are decoded to characters (``A-Z`` lower-cased, white space as blanks).
Counts of hashed character n-grams, and of documents, are gathered over every
training document in one pass, combined map-side, and summed by Spark for each
(language, bucket).  The log-probability matrix has a fixed number of buckets for
each language and is broadcast in blocks of at most ``BLOCK`` languages, which
bounds it; a pass scores sparse batches in numpy against one block after another.
A text's language has the highest posterior: prior share of documents times the
product of its n-grams' probabilities.

Cases: a null text, or one without any letter, gives ``und`` and score 0.  Rows
with a null language are scored but not learned from.  Without any training
row everything is ``und``.  Ties go to the alphabetically first language.
Repeated rows are scored alike; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm import textvec
from sitelattice.llm.runtime import Scratch, fold, own_names, renamed, segment_sum, table

UNDETERMINED = "und"
ORDERS, BITS, ALPHA = (1, 2, 3, 4), 15, 0.5
#: Languages in one broadcast matrix, 128 KB each; and those that a counting task holds before it hands on.
BLOCK = 256
#: The bucket that counts documents.
DOCUMENTS = -1


def _buckets(rows: pa.RecordBatch, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the n-grams' buckets of all rows end to end, and where each row's begin."""
    data, at = textvec.characters(*textvec.text_buffer(rows.column("text")))
    for n in orders:
        value, first = textvec.char_grams(data, at, n)
        yield ((value ^ np.uint32(n * 0x51ED27)) & np.uint32((1 << bits) - 1)).astype(np.int32), first


def count_ngrams(docs: DataFrame, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """(lang, bucket, n) over ``docs(text, lang)``; bucket ``DOCUMENTS`` counts the documents."""

    def rows_of(totals):
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            bucket = np.where(used == 1 << bits, DOCUMENTS, used).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used)), "bucket": pa.array(bucket), "n": pa.array(total[used])})
        totals.clear()

    def task(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in textvec.slices(batch, "text"):
                langs = rows.column("lang").to_pylist()
                known = {x: i for i, x in enumerate(sorted(set(langs)))}
                code = np.array([known[x] for x in langs])
                for lang, n in zip(known, np.bincount(code)):
                    if lang not in totals and len(totals) >= BLOCK:
                        yield from rows_of(totals)
                    totals.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))[1 << bits] += n
                for value, first in _buckets(rows, orders, bits):
                    owner = np.repeat(code, np.diff(first))
                    for lang, i in known.items():
                        mine = value if len(known) == 1 else value[owner == i]
                        totals.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))[: 1 << bits] += np.bincount(mine, minlength=1 << bits)
        yield from rows_of(totals)

    return docs.select("text", "lang").mapInArrow(task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_probabilities(counts: DataFrame, langs: list[str], documents: list[int], total: int, bits: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-prior of each of ``langs`` (sorted) and their (bucket, language) matrix of smoothed log-probabilities."""
    found = counts.where((F.col("bucket") != DOCUMENTS) & F.col("lang").isin(langs)).toArrow()  # at most 2 ** bits rows for each
    matrix = np.full((1 << bits, len(langs)), alpha)
    column = np.searchsorted(np.array(langs, object), np.array(found["lang"].to_pylist(), object)) if found.num_rows else np.zeros(0, np.int64)
    matrix[found["bucket"].to_numpy(), column] += found["n"].to_numpy()
    return np.log(np.array(documents) / total), np.log(matrix / matrix.sum(0)).astype(np.float32)


def identify(docs: DataFrame, train: DataFrame, keep: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS, alpha: float = ALPHA) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score (posterior probability)."""
    spark, inner = docs.sparkSession, own_names(keep)
    scratch = Scratch(spark, "language-id")
    counts = scratch.keep(count_ngrams(train.where("lang IS NOT NULL"), orders, bits), "counts")
    known = [(r.lang, r.n) for r in counts.where(F.col("bucket") == DOCUMENTS).orderBy("lang").collect()]  # a row for each language
    total = sum(n for _, n in known)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    none = (F.lit(None).cast("string").alias("_best"), F.lit(float("-inf")).alias("_top"), F.lit(float("-inf")).alias("_sum"))
    rows = docs.select(*renamed(docs, keep, inner), "text", letter, *none)

    def scored_by(block: int, names: list[str]):
        langs, documents = zip(*known[block : block + BLOCK])
        model = spark.sparkContext.broadcast((langs, *log_probabilities(counts, list(langs), list(documents), total, bits, alpha)))

        def task(batches):
            langs, prior, matrix = model.value
            for batch in batches:
                for rows in textvec.slices(batch, "text"):
                    likely = prior + sum(segment_sum(matrix[value], first) for value, first in _buckets(rows, orders, bits))
                    at, top = likely.argmax(1), likely.max(1)
                    before, so_far = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_top", "_sum"))
                    best = [langs[i] if new else old for i, new, old in zip(at, top > before, rows.column("_best").to_pylist())]
                    whole = np.logaddexp(so_far, top + np.log(np.exp(likely - top[:, None]).sum(1)))
                    new = {"_best": pa.array(best, pa.string()), "_top": pa.array(np.maximum(before, top)), "_sum": pa.array(whole)}
                    yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in names], names)

        return task

    for block in range(0, len(known), BLOCK):
        names = [c for c in rows.columns if c != "text" or block + BLOCK < len(known)]  # the last pass needs no text any more
        rows = rows.mapInArrow(scored_by(block, names), rows.select(*names).schema)
    scratch.drop(counts)
    named = F.col("_letter") & F.col("_best").isNotNull()
    score = F.when(named, F.least(F.exp(F.col("_top") - F.col("_sum")), F.lit(1.0))).otherwise(0.0)
    return rows.select(*(F.col(i).alias(k) for i, k in zip(inner, keep)), F.when(named, F.col("_best")).otherwise(UNDETERMINED).alias("lang_pred"), score.alias("score"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(fold("doc_id", 4) != 2), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
