"""Interval algebra: merging, overlap, containment and range joins within a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT_GAP_MS = 200
MIN_BARGE_IN_MS = 300
MAPPING_TOLERANCE_MS = 160
#: Width of the time cells that range joins meet in, so that a long call is many keys.
CELL_MS = 3_600_000
MOST_CELLS = 1000


def merged(spans: DataFrame, keys: list[str], gap_ms: int = AGENT_GAP_MS) -> DataFrame:
    """(keys, island, from_ms, to_ms, speaking_ms): spans that touch within a gap as one."""
    order = Window.partitionBy(*keys).orderBy("started_ms", "ended_ms")
    reach = F.max("ended_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("started_ms") > reach + gap_ms), 1).otherwise(0)
    marked = spans.withColumn("__new", new)
    islands = marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("started_ms").alias("from_ms"), F.max("ended_ms").alias("to_ms")).withColumn("speaking_ms", F.col("to_ms") - F.col("from_ms"))


def _cells(start: Column, end: Column, width: int) -> Column:
    """The cells that an interval touches; none if it ends before it starts."""
    return F.explode(F.when(end >= start, F.sequence(F.floor(start / width), F.floor(end / width))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = CELL_MS) -> DataFrame:
    """Pairs of intervals (l_id, l_from, l_to) and (r_id, r_from, r_to) of one key that
    share time, with ``overlap_ms``. Both are dealt to time cells; a pair is given by the
    cell where its overlap begins only. An interval of more than MOST_CELLS cells, such as
    one with a wrong end, is dealt to none but meets the other side by its key alone;
    one that ends before it starts shares no time."""
    wide = lambda p: F.col(f"{p}_to") - F.col(f"{p}_from") > F.lit(MOST_CELLS * width)
    shared = (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to")) & (F.col("l_from") <= F.col("l_to")) & (F.col("r_from") <= F.col("r_to"))
    begin = F.greatest("l_from", "r_from")
    a = left.filter(~wide("l")).withColumn("cell", _cells(F.col("l_from"), F.col("l_to"), width))
    b = right.filter(~wide("r")).withColumn("cell", _cells(F.col("r_from"), F.col("r_to"), width))
    in_cells = a.join(b, [*keys, "cell"]).filter(shared & (F.col("cell") == F.floor(begin / width))).drop("cell")
    by_key = left.filter(wide("l")).join(right, keys).unionByName(left.filter(~wide("l")).join(right.filter(wide("r")), keys)).filter(shared)
    return in_cells.unionByName(by_key).withColumn("overlap_ms", F.least("l_to", "r_to") - begin)


def words_to_turns(words: DataFrame, turns: DataFrame, key: str = "session_id", tolerance: int = MAPPING_TOLERANCE_MS, width: int = CELL_MS) -> DataFrame:
    """Each word (word_id, onset_ms) to the turn whose window, widened by the
    tolerance, holds its onset: status mapped, ambiguous (never guessed) or unmapped."""
    wide = turns.select(key, "turn_id", (F.col("started_ms") - tolerance).alias("__from"), (F.col("ended_ms") + tolerance).alias("__to"))
    wide = wide.withColumn("__cell", _cells(F.col("__from"), F.col("__to"), width))
    placed = words.withColumn("__cell", F.floor(F.col("onset_ms") / width))
    found = placed.join(wide, [key, "__cell"]).filter("onset_ms >= __from and onset_ms < __to").groupBy("word_id").agg(F.count("*").alias("candidates"), F.min("turn_id").alias("turn_id"))
    out = words.join(found, "word_id", "left")
    status = F.when(F.col("candidates").isNull(), "unmapped").when(F.col("candidates") > 1, "ambiguous").otherwise("mapped")
    return out.select("word_id", key, status.alias("mapping"), F.when(F.col("candidates") == 1, F.col("turn_id")).alias("turn_id"))


def barge_in(caller: DataFrame, agent: DataFrame, minimum: int = MIN_BARGE_IN_MS) -> DataFrame:
    """Caller turns over which merged agent speech lasted at least ``minimum`` ms."""
    spoken = merged(agent, ["session_id"]).select("session_id", F.col("from_ms").alias("r_from"), F.col("to_ms").alias("r_to"), F.col("island").alias("r_id"))
    left = caller.select("session_id", F.col("turn_id").alias("l_id"), F.col("started_ms").alias("l_from"), F.col("ended_ms").alias("l_to"))
    return overlaps(left, spoken, ["session_id"]).groupBy("session_id", F.col("l_id").alias("turn_id")).agg(F.sum("overlap_ms").alias("overlap_ms")).filter(F.col("overlap_ms") >= minimum)


def outermost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that no other span of their key encloses; of identical ones, one."""
    one = spans.dropDuplicates([*keys, "started_ms", "ended_ms"])
    order = Window.partitionBy(*keys).orderBy(F.col("started_ms"), F.col("ended_ms").desc())
    reach = F.max("ended_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("__reach", reach).filter(F.col("__reach").isNull() | (F.col("ended_ms") > F.col("__reach"))).drop("__reach")


def midpoint_windows(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Windows that meet halfway between neighbouring turns."""
    order = Window.partitionBy(key).orderBy("started_ms", "turn_id")
    before, after = F.lag("ended_ms").over(order), F.lead("started_ms").over(order)
    low = F.coalesce(F.expr("0") + F.floor((before + F.col("started_ms")) / 2), F.col("started_ms"))
    high = F.coalesce(F.floor((F.col("ended_ms") + after) / 2), F.col("ended_ms"))
    return turns.select(key, "turn_id", low.alias("window_from"), high.alias("window_to"))


def mapping_windows(turns: DataFrame) -> DataFrame:
    """Turns without words reach back to the end of the worded turn before them, or to 0."""
    order = Window.partitionBy("session_id").orderBy("started_ms", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("ended_ms").over(order)
    return turns.select("session_id", "turn_id", F.when(F.col("worded"), F.col("started_ms")).otherwise(F.coalesce(F.least(before, F.col("started_ms")), F.lit(0))).alias("window_from"), F.col("ended_ms").alias("window_to"))


def playout_clock(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each chunk starts at its arrival or at the end of the one before, whichever is later."""
    order = Window.partitionBy(*keys).orderBy("seq")
    earlier = F.coalesce(F.sum("duration_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chunks.withColumn("__earlier", earlier).withColumn("__slack", F.col("arrival_ms") - F.col("__earlier"))
    return placed.withColumn("playout_ms", F.col("__earlier") + F.max("__slack").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__earlier", "__slack")


def response_gap(gaps: DataFrame, spans: DataFrame) -> DataFrame:
    """How much of each silence (turn_id, from_ms, to_ms) each stage covers, overlaps
    of a stage counted once, and the stage that covers most."""
    clipped = spans.join(gaps, ["session_id", "turn_id"]).select("session_id", "turn_id", "stage", F.greatest("started_ms", "from_ms").alias("started_ms"), F.least("ended_ms", "to_ms").alias("ended_ms")).filter("started_ms < ended_ms")
    each = merged(clipped, ["session_id", "turn_id", "stage"], 0).groupBy("session_id", "turn_id", "stage").agg(F.sum("speaking_ms").alias("covered_ms"))
    return each.groupBy("session_id", "turn_id").agg(F.max("covered_ms").alias("top_ms"), F.max_by("stage", F.struct("covered_ms", "stage")).alias("top_stage"), F.sum("covered_ms").alias("total_ms"))


def nearest_counterpart(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left span the overlapping right span that starts nearest."""
    pairs = overlaps(left, right, ["session_id"])
    return pairs.groupBy("session_id", "l_id").agg(F.min_by("r_id", F.struct(F.abs(F.col("l_from") - F.col("r_from")), "r_id")).alias("r_id"))


def tightest_enclosing(inner: DataFrame, outer: DataFrame, slack_ms: int = 500) -> DataFrame:
    """For each inner span the enclosing outer span, allowing some slack, that starts last.
    A span without length is enclosed like any other, at either end too."""
    start, end = F.col("l_from"), F.col("l_to")
    reach = inner.select("session_id", "l_id", start.alias("__from"), end.alias("__to"), F.least(start, end).alias("l_from"), (F.greatest(start, end) + 1).alias("l_to"))
    wide = outer.withColumn("r_from", F.col("r_from") - slack_ms).withColumn("r_to", F.col("r_to") + slack_ms + 1)  # half open, so that an instant shares time
    inside = overlaps(reach, wide, ["session_id"]).filter("__from >= r_from and __to < r_to")
    return inside.groupBy("session_id", "l_id").agg(F.max_by("r_id", F.struct("r_from", "r_id")).alias("r_id"))
