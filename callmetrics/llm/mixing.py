"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Expected copies are whole multiples of 1 / UNIT, so that prefix sums are exact.
UNIT = 1 << 20
WEIGHTS = (5, 2, 1)
CAP = 3


def word_count(text: Column) -> Column:
    """Words of a text: runs without space, tab, line feed, vertical tab, form feed or carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, take the weights in turn and share the total
    size; a target above ``cap`` times its source's size stops there and the excess is
    shared again by weight. That fills sources in order of cap over weight: the first
    one that the remaining share does not fill fixes the share for all after it. A
    source without words has target 0. One row per source, so the windows without a
    partition hold as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"))
    sources = sources.withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    sources = sources.withColumn("share", (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    open_share = F.when(F.col("share") * F.col("weight") < F.col("most"), F.col("share"))
    level = F.first(open_share, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = level.isNull() | (level * F.col("weight") >= F.col("most"))
    return sources.select("source", "source_size", F.when(filled, F.col("most").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def systematic_copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """How often each row is taken so that every source comes near its target.

    ``sized`` holds doc_id, source and size (words), and any other columns, which stay.
    Within a source, rows are ordered by size class, then by an MD5 of the id; their
    expected copies (target over source size, at most ``cap``) are summed along that
    order, one random offset per source is added, and a row is taken once for each
    whole number its own interval crosses. Adds source_size, target, copies and taken
    (copies times size); rows that are not taken have 0.

    No window holds a source: ranges of the order (size class and two hex digits of the
    MD5) are summed first, which gives each range its start. The offset depends on the
    source's name only, so reruns agree. Null size counts as 0, a null source is a
    source of its own, a null id sorts as an empty one. Repeated rows are rows of their
    own; rows tied in id and size may exchange their copies.
    """
    bits = F.bin(F.col("size"))
    rows = (
        sized.withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
        .withColumn("__class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)))
        .withColumn("__md5", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
        .withColumn("__range", F.concat("__class", F.substring("__md5", 1, 2)))
        # one key that is never null, so that the window and the join share a partitioning
        .withColumn("__slot", F.concat_ws("/", "__range", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    )
    targets = source_targets(sized.select("source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), weights, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 5), 16, 10).cast("long")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(F.lit(0)).cast("long")
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target", expected.alias("__expected"), offset.alias("__offset"))
    ranges = rows.groupBy("source", "__range", "__slot").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "__slot", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    starts = ranges.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    inside = Window.partitionBy("__slot").orderBy("__md5", "size")
    crossed = "(__offset + (__before + __rank) * __expected) div {0} - (__offset + (__before + __rank - 1) * __expected) div {0}"
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(starts, "__slot")
        .withColumn("copies", F.expr(crossed.format(UNIT)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__class", "__md5", "__range", "__slot", "__rank", "__before", "__expected", "__offset")
    )
