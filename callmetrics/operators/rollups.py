"""Hourly tiers of turns, calls, tools and failures, and what any range of hours tells.

Turns count in the hour they happened, calls in the hour they began, so a call is counted
once however many hours it spans; a turn that continues another is measured but is no
further exchange. Each row stands for an agent or for all of them. What sums cannot merge
is kept in a form that merges: latencies as sketches, distinct calls as HyperLogLog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.scalars import LAG_MS, bucket_floor
from callmetrics.operators import measures
from callmetrics.operators.facts import STAGES, complete_calls, complete_turns
from callmetrics.operators.measures import ALL_AGENTS, HOUR_MS

#: Latencies of turns that have a sketch in every hour.
METRICS = (
    "response_ms", "stt_first_partial_ms", "stt_endpoint_delay_ms", "stt_final_ms", "llm_ttft_ms", "llm_completion_ms", "tts_first_audio_ms", "tts_synthesis_ms", "tool_total_ms",
)
#: Sums over turns, counts of their calls by stage, and sums over calls.
TURN_COUNTERS = (
    "turns", "split_turns", "measured", "lag_turns", *(f"{s}_ops" for s in STAGES), *(f"{s}_failed" for s in STAGES), "tts_interrupted", "stt_missing_final", "stt_forced_flush",
    *(f"{s}_turns" for s in STAGES), *(f"{s}_split_turns" for s in STAGES),
)
IMPACTED = tuple(f"{s}_calls_impacted" for s in STAGES)
CALL_COUNTERS = ("calls", "failing_calls", "capture_incomplete_calls", "completed_calls", "incomplete_calls", "total_duration_ms")
#: 2 ** PRECISION registers: a standard error of 0.8 %, and exact for small counts.
PRECISION = 14
#: Kept beside a count of distinct calls; their union over hours counts no call twice.
SKETCHED = tuple(f"{s}_failed_calls_hll" for s in STAGES)


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast("long")), F.lit(0).cast("long"))


def turn_sums() -> dict[str, Column]:
    """TURN_COUNTERS as aggregates over complete_turns()."""
    ran = lambda s: F.col(f"{s}_ops") > 0
    out = {
        "turns": F.count_if(~F.col("is_continuation")), "split_turns": F.count_if("has_continuation"), "measured": F.count("response_ms"), "lag_turns": F.count_if(F.col("response_ms") >= LAG_MS),
        **{f"{s}_{kind}": _sum(F.col(f"{s}_{kind}")) for kind in ("ops", "failed") for s in STAGES}, "tts_interrupted": _sum(F.col("tts_interrupted")),
        "stt_missing_final": F.count_if("stt_missing_final"), "stt_forced_flush": F.count_if("stt_forced_flush"),
        **{f"{s}_turns": F.count_if(ran(s)) for s in STAGES}, **{f"{s}_split_turns": F.count_if(f"{s}_split") for s in STAGES},
    }
    return {name: value.alias(name) for name, value in out.items()}


def distinct_calls(counts: Column) -> Column:
    """A mergeable count of the calls (rows of ``session_id``) for which ``counts`` holds."""
    return F.hll_sketch_agg(F.when(counts, F.col("session_id")), F.lit(PRECISION))


def estimate(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("long")


def in_scopes(df: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Aggregates of ``values`` by ``keys`` and agent, and by ``keys`` over all agents.
    A call without an agent has the agent ''."""
    agent = F.col("agent_id")
    own = [F.col(k) for k in keys]
    rolled = df.withColumn("agent_id", F.coalesce("agent_id", F.lit(""))).groupingSets([[*own, agent], own], *own, agent).agg(F.grouping("agent_id").alias("__all"), *values)
    return rolled.withColumn("agent_id", F.when(F.col("__all") == 1, ALL_AGENTS).otherwise(agent)).drop("__all")


def in_buckets(df: DataFrame, width: int) -> DataFrame:
    return df.filter("started_ms is not null").withColumn("bucket_ms", bucket_floor(F.col("started_ms"), width))


def interval_rollup(turns: DataFrame, calls: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """All counters of each bucket and agent, and of each bucket over all agents.

    Turns are summed by call first, so that a stage's failing calls are counted without
    a distinct; the two grains meet in a full join, as an hour may hold turns of calls
    that began before it, and calls whose turns came later.
    """
    keys = ["bucket_ms", "agent_id"]
    each = in_buckets(complete_turns(turns), width).groupBy(*keys, "session_id").agg(*turn_sums().values())
    failing = lambda s: F.col(f"{s}_failed") > 0
    of_turns = in_scopes(
        each, ["bucket_ms"], *(_sum(F.col(c)).alias(c) for c in TURN_COUNTERS), *(F.count_if(failing(s)).alias(f"{s}_calls_impacted") for s in STAGES),
        *(distinct_calls(failing(s)).alias(f"{s}_failed_calls_hll") for s in STAGES),
    )
    of_calls = in_scopes(in_buckets(complete_calls(calls), width), ["bucket_ms"], *call_sums().values())
    both = of_turns.join(of_calls, keys, "full")
    counters = (*TURN_COUNTERS, *IMPACTED, *CALL_COUNTERS)
    return both.select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counters), *SKETCHED)


def call_sums() -> dict[str, Column]:
    """CALL_COUNTERS as aggregates over complete_calls()."""
    out = {
        "calls": F.count("*"), "failing_calls": F.count_if(F.col("failed_ops") > 0), "capture_incomplete_calls": F.count_if("capture_incomplete"),
        "completed_calls": F.count_if(F.col("outcome") == "completed"), "incomplete_calls": F.count_if(F.col("status") != "ready"), "total_duration_ms": _sum(F.col("duration_ms")),
    }
    return {name: value.alias(name) for name, value in out.items()}


def metric_rollup(turns: DataFrame, metrics: tuple[str, ...] = METRICS, width: int = HOUR_MS) -> DataFrame:
    """A sketch of each latency by bucket and agent, and over all agents."""
    long = in_buckets(complete_turns(turns), width).select("bucket_ms", "agent_id", *(F.col(m).cast("double") for m in metrics)).unpivot(["bucket_ms", "agent_id"], list(metrics), "metric", "value")
    own = measures.sketch_build(long, ["bucket_ms", "agent_id", "metric"], "value")
    return in_scopes(own, ["bucket_ms", "metric", "idx"], *measures.sketch_sums())


def in_turns(tools: DataFrame, turns: DataFrame) -> DataFrame:
    """Tool rows with their turn's agent and start, which place them in time."""
    return tools.drop("agent_id", "started_ms").join(turns.select("session_id", "turn_id", "agent_id", "started_ms"), ["session_id", "turn_id"])


def tool_rollup(tools: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """Invocations, failures, time-outs and calls of each tool by bucket and agent.
    ``tools`` are tool facts as in_turns() places them."""
    keys = ["bucket_ms", "tool_name"]
    each = in_buckets(tools, width).groupBy(*keys, "agent_id", "session_id").agg(F.count("*").alias("invocations"), F.count_if("failed").alias("failed"), F.count_if("timed_out").alias("timed_out"))
    return in_scopes(
        each, keys, *(F.sum(c).alias(c) for c in ("invocations", "failed", "timed_out")), F.count("*").alias("calls"), F.count_if(F.col("failed") > 0).alias("failed_calls"),
        distinct_calls(F.lit(True)).alias("calls_hll"), distinct_calls(F.col("failed") > 0).alias("failed_calls_hll"),
    )


def tool_sketches(tools: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """A sketch of each tool's durations by bucket and agent."""
    own = measures.sketch_build(in_buckets(tools, width).withColumn("duration_ms", F.col("duration_ms").cast("double")), ["bucket_ms", "agent_id", "tool_name"], "duration_ms")
    return in_scopes(own, ["bucket_ms", "tool_name", "idx"], *measures.sketch_sums())


def failure_rollup(failures: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """How often each failure occurred, and in how many calls, by bucket and agent."""
    keys = ["bucket_ms", "stage", "fingerprint"]
    each = in_buckets(failures, width).groupBy(*keys, "agent_id", "session_id").agg(F.count("*").alias("n"))
    return in_scopes(each, keys, F.sum("n").alias("n"), F.count("*").alias("calls"), distinct_calls(F.lit(True)).alias("calls_hll"))


@dataclass(frozen=True)
class Tiers:
    """The hourly tables that stand for all turns, calls, tools and failures."""

    intervals: DataFrame
    metrics: DataFrame
    tools: DataFrame
    tool_sketches: DataFrame
    failures: DataFrame

    NAMES = ("intervals", "metrics", "tools", "tool_sketches", "failures")

    def between(self, start_ms: int, end_ms: int, agent_id: str | None = None) -> Tiers:
        """Rows of the hours that begin in the range, of one agent or of all together."""
        here = (F.col("bucket_ms") >= start_ms) & (F.col("bucket_ms") < end_ms) & (F.col("agent_id") == (ALL_AGENTS if agent_id is None else agent_id))
        return Tiers(*(getattr(self, name).filter(here) for name in self.NAMES))


def build(turns: DataFrame, calls: DataFrame, tools: DataFrame, failures: DataFrame, width: int = HOUR_MS) -> Tiers:
    """All tiers of the facts given. Failures without a time are in no hour."""
    return build_placed(turns, calls, in_turns(tools, turns), failures, width)


def build_placed(turns: DataFrame, calls: DataFrame, tools: DataFrame, failures: DataFrame, width: int = HOUR_MS) -> Tiers:
    """build() of tools that in_turns() has placed."""
    return Tiers(interval_rollup(turns, calls, width), metric_rollup(turns, METRICS, width), tool_rollup(tools, width), tool_sketches(tools, width), failure_rollup(failures, width))


def range_counters(intervals: DataFrame, *keys: str) -> DataFrame:
    """Sums over hours, by ``keys`` if any. Calls that a stage's failures touched are
    estimated from the union of the hours' sketches, never more than the turns that say so
    could be; everything else is exact."""
    counters = (*TURN_COUNTERS, *CALL_COUNTERS)
    touched = (F.least(estimate(f"{s}_failed_calls_hll"), _sum(F.col(f"{s}_calls_impacted"))).alias(f"{s}_calls_impacted") for s in STAGES)
    return intervals.groupBy(*keys).agg(*(_sum(F.col(c)).alias(c) for c in counters), *touched)


def range_tools(tiers: Tiers) -> DataFrame:
    """Each tool over the hours: exact counts, estimated calls, percentiles of merged sketches."""
    counts = tiers.tools.groupBy("tool_name").agg(
        *(F.sum(c).alias(c) for c in ("invocations", "failed", "timed_out")), F.least(estimate("calls_hll"), F.sum("calls")).alias("calls"), F.least(estimate("failed_calls_hll"), F.sum("failed_calls")).alias("failed_calls")
    )
    stats = measures.sketch_summary(tiers.tool_sketches, ["tool_name"]).select("tool_name", F.col("n").alias("measured"), "p50", "p95", "p95_confident")
    return counts.join(stats, "tool_name", "left")


def range_failures(failures: DataFrame) -> DataFrame:
    """Each failure over the hours: exact counts, estimated calls."""
    return failures.groupBy("fingerprint", "stage").agg(F.sum("n").alias("n"), F.least(estimate("calls_hll"), F.sum("calls")).alias("calls"))
