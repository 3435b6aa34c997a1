"""Cutting lineage where every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set for the session, but only if
    all tasks run in this process: on a cluster, executors would each write to a disk of
    their own, so that must name a folder that all can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.conf.get("spark.master").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='callmetrics-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table written there: its lineage is cut, it is computed once, and later
    plans know its size."""
    path = f"{shared_path(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
