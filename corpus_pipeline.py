"""Corpus pipeline: quality rules, near-dedup, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and rereads it as the next
stage's docs, so a lost executor costs no more than its stage. All but the
last return the columns of documents. Rows without a doc_id pass through the
stages that need one; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontaminate, mixing, quality, secrets, simhash
from logloom.llm.common import Written, table

STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("secret_scans", secrets.stage),
    ("mixing", mixing.stage),
]

#: Fingerprint components and the learned n-gram ratio have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that come out of all stages, with domain, epoch and tokens."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs
