"""A training corpus from ``documents``: language, toxicity, near-duplicates, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmetrics.llm import pipeline
from callmetrics.llm.storage import read_table, written

STAGES = [
    ("language_id", pipeline.keep_known_languages),
    ("toxicity", pipeline.drop_toxic),
    ("near_dedup", pipeline.drop_near_duplicates),
    ("mixing", pipeline.mix_sources),
    ("bpe", pipeline.encode),
]

#: Trained models and xxhash fingerprints are beyond SQL. Tests hold the operators that the stages
#: call against brute force or held-out rows, and the stages' rows against those they were given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
