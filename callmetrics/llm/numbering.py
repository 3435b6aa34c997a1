"""Gapless numbers for rows without sorting any large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window partition of numbered() holds, about.
BUCKET_ROWS = 100_000


def numbered(df: DataFrame, by: list[str], order: list[Column], rows: int, out: str, repeats: str | None = None) -> DataFrame:
    """Number the rows of each ``by`` group from 0, without gaps, in column ``out``.

    Rows are dealt to buckets by a hash of the order columns; a small table of bucket
    sizes gives where each bucket starts, so a group with most of the rows is still
    numbered by many tasks. Rows that tie in all order columns share a bucket and take
    its numbers in any order; where many may tie, count them first and name the count in
    ``repeats``: a row then takes that many numbers, from ``out`` on. ``df`` is evaluated
    twice and should be a written table; ``rows`` is its row count, about.
    """
    taken = F.col(repeats) if repeats else F.lit(1)
    buckets = max(1, rows // BUCKET_ROWS + 1)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(*by, "__bucket").agg(F.sum(taken).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("__rank", F.sum(taken).over(inside) - taken)
        .join(starts, [*by, "__bucket"])
        .withColumn(out, F.col("__from") + F.col("__rank"))
        .drop("__bucket", "__rank", "__from")
    )
