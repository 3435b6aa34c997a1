"""A call as a reviewer reads it: its spans in groups, each under what encloses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.operators.intervals import overlaps
from callmetrics.sources.shared import checkpointed

#: Framework and transport spans are timed on either side of a wait.
NEST_SLACK_MS = 500


def is_socket() -> Column:
    """A provider connection, which serves the whole call."""
    return F.coalesce(F.col("scope") == "connection", F.lit(False)) | (F.col("turn_id").isNull() & F.coalesce(F.col("transport") == "websocket", F.lit(False)))


def is_attempt() -> Column:
    """A model call's transport attempt: it carries a request's body or a status, or accounts for no tokens."""
    r = F.col("response")
    physical = F.coalesce(F.col("request.body") != "", F.lit(False)) | r["status"].isNotNull()
    silent = r["total_tokens"].isNull() & r["completion_tokens"].isNull() & r["ttft_ms"].isNull()
    return (F.col("type") == "llm") & ~is_socket() & (physical | silent)


def _extent(ops: DataFrame, prefix: str, slack: int = 0) -> DataFrame:
    start = F.coalesce("started_at_ms", F.lit(0)).cast("long")
    end = F.coalesce(F.col("ended_at_ms").cast("long"), start)
    return ops.select(
        "session_id", F.col("event_id").alias(f"{prefix}_id"), F.col("turn_id").alias(f"{prefix}_turn"), (start - slack).alias(f"{prefix}_from"), (end + slack + 1).alias(f"{prefix}_to")
    )


def served_calls(ops: DataFrame) -> DataFrame:
    """(session_id, event_id, parent_id): each transport attempt under the model call of
    its turn that encloses it with some slack; of several, the one that starts last."""
    llm = ops.filter((F.col("type") == "llm") & ~is_socket())
    inner, outer = _extent(llm.filter(is_attempt()), "l"), _extent(llm.filter(~is_attempt()), "r", NEST_SLACK_MS)
    held = overlaps(inner, outer, ["session_id"]).filter("l_from >= r_from and l_to <= r_to and l_turn <=> r_turn")
    return held.groupBy("session_id", F.col("l_id").alias("event_id")).agg(F.max_by("r_id", F.struct("r_from", "r_id")).alias("parent_id"))


def tightest_enclosers(ops: DataFrame) -> DataFrame:
    """(session_id, event_id, enclosing_id): for each span of a call the span that encloses it
    most tightly: of those that start no later and end no sooner, the one that starts last,
    then ends first. Of spans with one extent the earlier by id encloses the next, so the
    result is a forest."""
    pairs = overlaps(_extent(ops, "l"), _extent(ops, "r"), ["session_id"]).filter("r_from <= l_from and r_to >= l_to and (r_from < l_from or r_to > l_to or r_id < l_id)")
    tight = F.struct(F.col("r_from"), -F.col("r_to"), F.col("r_id"))
    return pairs.groupBy("session_id", F.col("l_id").alias("event_id")).agg(F.max_by("r_id", tight).alias("enclosing_id"))


def depths(forest: DataFrame) -> DataFrame:
    """(session_id, event_id, depth) of rows (session_id, event_id, up; NULL at the roots). Each
    round doubles the steps that a row has climbed, so the rounds are few at any depth."""
    now = checkpointed(forest.select("session_id", "event_id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    while not now.filter("up is not null").isEmpty():
        above = now.select("session_id", F.col("event_id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__more"))
        now = checkpointed(now.join(above, ["session_id", "up"], "left").select("session_id", "event_id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth")))
    return now.select("session_id", "event_id", "depth")


def session_trace(ops: DataFrame, turns: DataFrame) -> DataFrame:
    """Q05: one row a span of each call.

    ``section``: its turn ('turn:<id>', if ``turns`` has it), 'loose' outside any, or
    'sockets', which serve the whole call and enclose nothing. ``parent_id``: the model
    call that an attempt served; ``enclosing_id`` and ``depth``: where it lies in the forest
    of the call's spans, whatever their kind. ``place`` orders the spans of a section that
    serve no other, and those that serve one among themselves, by start, then id.
    """
    spans = ops.filter(~is_socket())
    forest = spans.select("session_id", "event_id").join(tightest_enclosers(spans), ["session_id", "event_id"], "left").withColumnRenamed("enclosing_id", "up")
    forest = checkpointed(forest)
    known = turns.select("session_id", "turn_id").distinct().withColumn("__known", F.lit(True))
    out = ops.join(known, ["session_id", "turn_id"], "left").join(served_calls(ops), ["session_id", "event_id"], "left").join(forest.withColumnRenamed("up", "enclosing_id"), ["session_id", "event_id"], "left").join(depths(forest), ["session_id", "event_id"], "left")
    section = F.when(is_socket(), "sockets").when(F.col("__known"), F.concat(F.lit("turn:"), "turn_id")).otherwise("loose")
    start = F.coalesce("started_at_ms", F.lit(0))
    out = out.withColumn("section", section).withColumn("place", F.row_number().over(Window.partitionBy("session_id", "section", "parent_id").orderBy(start, "event_id")))
    return out.select("session_id", "section", "event_id", "type", "parent_id", "enclosing_id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "place")
