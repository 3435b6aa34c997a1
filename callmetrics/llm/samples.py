"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(light: DataFrame, by: str, per_value: int) -> DataFrame:
    """At most ``per_value`` rows of each value of ``by``: those with the least hash of doc_id.

    ``light`` holds doc_id and ``by``, without nulls in either. A hash threshold from
    the counts thins large values before any shuffle, so no task reads or ranks more
    than about the bound.
    """
    hashed = light.withColumn("__h", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)))
    counts = light.groupBy(by).agg(F.count("*").alias("__n"))
    # bounded: one row for each value, of which models hold a column or a weight each
    thin = hashed.join(F.broadcast(counts), by).filter(F.col("__h") * F.col("__n") <= F.lit(float(per_value * 1.3 + 50) * (1 << 30)))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__h", "doc_id"))
    return thin.withColumn("__rank", rank).filter(F.col("__rank") <= per_value).select("doc_id", by)
