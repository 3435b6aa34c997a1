"""Turn, call, tool and failure facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions.scalars import LAG_MS, MIN_REPLY_MS, error_fingerprint, has_failed, is_interrupted, is_timeout
from callmetrics.sources.shared import checkpointed

STAGES = ("stt", "llm", "tts", "tool")


def flagged(ops: DataFrame) -> DataFrame:
    return ops.withColumn("failed", has_failed(F.col("status"), F.col("error_name"))).withColumn("interrupted", is_interrupted(F.col("status"), F.col("error_name")))


def turn_facts(ops: DataFrame) -> DataFrame:
    """One row a turn: extent, status (error over cancelled over ok), counts by stage and
    the reply's latency, which is not given below MIN_REPLY_MS."""
    at = lambda s: F.col("stage") == s
    reply = F.max(F.when(F.col("stage").isin("llm", "tts"), F.col("duration_ms")))
    return flagged(ops).groupBy("session_id", "turn_id").agg(
        F.first("agent_id").alias("agent_id"), F.min("started_ms").alias("started_ms"), F.max("ended_ms").alias("ended_ms"), (F.max("ended_ms") - F.min("started_ms")).alias("duration_ms"),
        F.when(F.max("failed"), "error").when(F.max("interrupted"), "cancelled").otherwise("ok").alias("status"), F.when(reply >= MIN_REPLY_MS, reply).alias("response_ms"),
        *(F.count_if(at(s)).alias(f"{s}_ops") for s in STAGES), *(F.count_if(at(s) & F.col("failed")).alias(f"{s}_failed") for s in STAGES),
        F.count_if(at("tts") & F.col("interrupted")).alias("tts_interrupted"), *(F.min(F.when(at(s), F.col("provider"))).alias(f"{s}_provider") for s in STAGES[:3]),
    )


def call_facts(turns: DataFrame) -> DataFrame:
    """One row a call, at the time of its first turn; turns that continue another are none of their own."""
    exchanges = F.count_if(~F.col("is_continuation")) if "is_continuation" in turns.columns else F.count("*")
    failed = sum((F.col(f"{s}_failed") for s in STAGES[1:]), F.col("stt_failed"))
    return turns.groupBy("session_id").agg(
        F.first("agent_id").alias("agent_id"), F.min("started_ms").alias("started_ms"), (F.max("ended_ms") - F.min("started_ms")).alias("duration_ms"), exchanges.alias("turns"),
        F.sum(failed).alias("failed_ops"), F.sum("tts_interrupted").alias("interrupted"), F.count_if(F.col("response_ms") >= LAG_MS).alias("lag_turns"), F.count("response_ms").alias("measured"), F.max("response_ms").alias("max_response_ms"),
        *(F.sum(f"{s}_failed").alias(f"{s}_failed") for s in STAGES),
    )


def _with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    return df.select("*", *(F.lit(value).cast(kind).alias(c) for c, (kind, value) in defaults.items() if c not in df.columns))


#: What facts of other sources may lack, and what stands for it.
_TURN_DEFAULTS: dict[str, tuple[str, object]] = {
    **{c: ("boolean", False) for c in ("is_continuation", "has_continuation", "inferred_reply", "stt_missing_final", "stt_forced_flush", *(f"{s}_split" for s in STAGES))},
    **{c: ("long", None) for c in ("stt_first_partial_ms", "stt_endpoint_delay_ms", "stt_final_ms", "llm_ttft_ms", "llm_completion_ms", "tts_first_audio_ms", "tts_synthesis_ms", "tool_total_ms")},
    **{f"{s}_{c}": ("string", None) for s in STAGES[:3] for c in ("provider", "model")},
}
_CALL_DEFAULTS: dict[str, tuple[str, object]] = {
    **{c: ("string", None) for c in ("environment", "agent_version", "sdk_language")}, "outcome": ("string", "unknown"), "status": ("string", "ready"), "capture_incomplete": ("boolean", False),
    **{c: ("long", 0) for c in ("missing_final_turns", "inferred_reply_turns", "split_turns", *(f"{s}_failed" for s in STAGES))},
}


def complete_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with every column that reports read; what was not captured is NULL or false."""
    return _with_defaults(turns, _TURN_DEFAULTS)


def complete_calls(calls: DataFrame) -> DataFrame:
    """``calls`` with every column that reports read."""
    return _with_defaults(calls, _CALL_DEFAULTS)


def tool_facts(ops: DataFrame) -> DataFrame:
    tools = flagged(ops).filter("stage = 'tool'")
    name = F.substring(F.coalesce("tool_name", F.lit("unnamed")), 1, 120)
    return tools.select("session_id", "turn_id", "op_id", name.alias("tool_name"), "duration_ms", "failed", is_timeout(F.col("status"), F.col("error_name"), F.lit(None)).alias("timed_out"))


def failure_facts(ops: DataFrame) -> DataFrame:
    return flagged(ops).filter("failed").select("session_id", "turn_id", "op_id", "stage", "agent_id", "started_ms", error_fingerprint(F.col("stage"), F.col("status"), F.col("error_name")).alias("fingerprint"))


def _folded(turns: DataFrame, rounds: int = 40) -> DataFrame:
    """(session_id, turn_id, root) of the turns that fold, see fold_roots(). What is followed
    are the turns that continue one that is there, however many others there are."""
    ids = turns.select("session_id", F.col("turn_id").alias("parent"))
    base = checkpointed(turns.select("session_id", "turn_id", F.col("continues_turn").alias("parent")).filter("parent is not null").join(ids, ["session_id", "parent"], "left_semi"))
    own = base.select("session_id", F.col("turn_id").alias("up"))
    starts = base.select("session_id", F.col("parent").alias("up")).distinct().join(own, ["session_id", "up"], "left_anti").select("session_id", "up", F.col("up").alias("over"), F.lit(True).alias("done"))
    climb = base.select("session_id", "turn_id", F.col("parent").alias("up")).withColumn("done", F.lit(False))
    left = -1
    for _ in range(rounds):
        steps = starts.union(climb.select("session_id", F.col("turn_id").alias("up"), F.col("up").alias("over"), "done"))
        climbed = climb.join(steps.withColumnRenamed("done", "known"), ["session_id", "up"])
        climb = checkpointed(climbed.select("session_id", "turn_id", F.col("over").alias("up"), (F.col("done") | F.col("known")).alias("done")))
        now = climb.filter("not done").count()
        if now == 0 or now == left:
            break
        left = now
    return climb.filter("done").select("session_id", "turn_id", F.col("up").alias("root"))


def fold_roots(turns: DataFrame, rounds: int = 40) -> DataFrame:
    """Adds ``root``: the turn that a chain of continuations starts from.

    ``turns`` holds session_id, turn_id and continues_turn. A turn folds only if its
    parent is present and the chain reaches a start; cycles and what hangs on them fold
    nothing, nor do orphans. Pointer jumping: each round doubles the steps that a row has
    climbed, so chains of 2 ** rounds are followed in as many joins.
    """
    return turns.join(_folded(turns, rounds), ["session_id", "turn_id"], "left").withColumn("root", F.coalesce("root", "turn_id"))


def folding(turns: DataFrame) -> DataFrame:
    """What split_marks() reads: a row a turn that folds (``root``) and a row a root of such
    turns (what they ran). ``turns`` has a row a turn; only turns that fold are grouped."""
    found = _folded(turns)
    parts = turns.select("session_id", "turn_id", *(v.alias(f"__{s}") for s, v in _ran().items())).join(found, ["session_id", "turn_id"])
    parts = parts.groupBy("session_id", F.col("root").alias("turn_id")).agg(F.lit(None).cast("string").alias("root"), F.lit(True).alias("__continued"), *(F.sum(f"__{s}").alias(f"__{s}") for s in STAGES))
    return found.unionByName(parts, allowMissingColumns=True)  # a root folds into nothing itself


def _ran() -> dict[str, Column]:
    return {s: F.coalesce((F.col(f"{s}_ops") > 0).cast("int"), F.lit(0)) for s in STAGES}


def split_marks() -> dict[str, Column]:
    """The columns of split_columns(), from turns that have met their row of folding(), if any."""
    folded = F.col("root").isNotNull()
    splits = {f"{s}_split": ~folded & (v + F.coalesce(f"__{s}", F.lit(0)) > 1) for s, v in _ran().items()}
    return {"root": F.coalesce("root", "turn_id"), "is_continuation": folded, "has_continuation": F.col("__continued").isNotNull(), **splits}


def split_columns(turns: DataFrame) -> DataFrame:
    """Adds is_continuation, has_continuation, exchange (root) and <stage>_split: whether
    more than one part of the exchange ran that stage, on its root. ``turns`` has a row a
    turn. Only turns that fold are grouped; the others are met once."""
    out = turns.join(folding(turns), ["session_id", "turn_id"], "left")
    return out.select(*turns.columns, *(v.alias(n) for n, v in split_marks().items()))


def op_reply_latency(ops: DataFrame) -> DataFrame:
    """caller's end of speech to the first agent audio of each turn, from spans with
    ended_ms of recognition and started_ms of synthesis; at least MIN_REPLY_MS."""
    stt_end = F.min(F.when(F.col("stage") == "stt", F.col("ended_ms")))
    heard = F.min(F.when(F.col("stage") == "tts", F.col("started_ms")))
    gap = heard - stt_end
    return ops.groupBy("session_id", "turn_id").agg(F.when(gap >= MIN_REPLY_MS, gap).alias("reply_ms"), F.min_by("op_id", F.struct("started_ms", "op_id")).alias("first_op"))


def logical_llm_calls(ops: DataFrame) -> DataFrame:
    """Model calls without the transport attempts whose start lies in a framework
    span of the same turn (``has_tokens``)."""
    llm = ops.filter("stage = 'llm'")
    frame = llm.filter("has_tokens").select("session_id", "turn_id", F.col("started_ms").alias("f_from"), F.col("ended_ms").alias("f_to"))
    inside = llm.filter("not has_tokens").join(frame, ["session_id", "turn_id"]).filter("started_ms >= f_from and started_ms <= f_to").select("op_id").distinct()
    return llm.join(inside, "op_id", "left_anti")


def when_stage(stage: str, value: Column) -> Column:
    return F.when(F.col("stage") == stage, value)
