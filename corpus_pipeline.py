"""The training-data pipeline: documents in, token ids out.

Each stage takes the documents that the one before it kept, written as Parquet and read again, so that a lost
executor never costs more than the running stage. What a stage wrote for itself, and what it read, is deleted once
its result is on disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, pieces, pii, quality, simhash
from sparkloom.llm.common import removed, scratch, shared_dir, table

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: Fingerprints, checksums and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result: ids, counts and digests per document copy."""
    docs, before = table(spark, sf_dir, "documents"), []
    base = f"{shared_dir(spark)}/sparkloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        removed(spark, before)
        docs, before = spark.read.parquet(f"{base}/{name}"), [f"{base}/{name}"]
    return docs
