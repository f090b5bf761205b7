"""Labelled rows for the classifiers: the training fold and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.runtime import bounded_sample, fold


def held_out():
    return fold("doc_id", 5) == 0


def sample_order() -> list[Column]:
    """The order in which a fit takes its rows: by a hash, so that parts of it are alike."""
    return [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]


def training_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out fold.

    The sampled identifiers and labels are at most ``most`` rows, so they are
    broadcast and no text is shuffled.  Labels other than 0 and 1 are ignored;
    of repeated labels for an identifier the larger one counts.
    """
    known = labels.where(~held_out() & F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = bounded_sample(known, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
