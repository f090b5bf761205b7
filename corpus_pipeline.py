"""The training-data pipeline: documents to shards in five stages.

Each stage takes the rows that its predecessor kept, written as Parquet and read
again, and works on all of them.  All but the last return the columns of the
documents; the last returns the shard and the place of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelattice.llm import decontaminate, minhash, mixing, quality, sharding
from sitelattice.llm.runtime import Scratch, table

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", minhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

#: Trained models and a latent space are not SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard table of the documents in ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.split()[0])
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
