"""Star-schema tables bound to operations, turns and calls.

``events`` rows are operations of pipeline stages: a user's week is a call, a day of
it a turn. The same binding as DuckDB SQL is ``OPERATIONS_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000

STAGE_OF = {"click": "stt", "view": "llm", "purchase": "tts", "signup": "tool"}
STAGES = ("stt", "llm", "tts", "tool")
ERROR_NAMES = ("AbortError", "TimeoutError", "RateLimitError", None, "CancelledError")
PROVIDERS = ("Deepgram", "deepgram-tts", "eastus.api.cognitive.microsoft.com", "azure openai", "llm", "host.example.org", "My Vendor")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, index: str) -> F.Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.expr(index).cast("int"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    events = events.withColumn("started_ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000")).withColumn("duration_ms", F.bround(F.col("value") * 60).cast("long"))
    failed = F.col("event_type") == "error"
    day = F.expr(f"started_ms div {DAY_MS}")
    stage = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STAGE_OF.items()), _pick(STAGES, "event_id % 4"))
    session = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.expr(f"started_ms div {7 * DAY_MS}").cast("string"))
    return events.select(
        F.col("event_id").alias("op_id"), session.alias("session_id"), F.concat(session, F.lit("/"), day.cast("string")).alias("turn_id"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 12).cast("string")).alias("agent_id"), "started_ms", "duration_ms", (F.col("started_ms") + F.col("duration_ms")).alias("ended_ms"), stage.alias("stage"),
        F.when(failed, "error").when(F.col("event_id") % 37 == 0, "cancelled").otherwise("ok").alias("status"),
        F.when(failed, _pick(ERROR_NAMES, "event_id % 5")).alias("error_name"), _pick(PROVIDERS, "event_id % 7").alias("provider"),
        F.when(stage == "tool", F.concat(F.lit("tool_"), (F.get_json_object("props", "$.k").cast("int") % 8).cast("string"))).alias("tool_name"),
    )


def _list(values: tuple) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


OPERATIONS_SQL = f"""
ops as (
  select op_id, session_id, session_id || '/' || (started_ms // {DAY_MS}) as turn_id, agent_id, started_ms, duration_ms, started_ms + duration_ms as ended_ms, stage, status, error_name, provider,
    case when stage = 'tool' then 'tool_' || (k % 8) end as tool_name
  from (
    select event_id as op_id, epoch_us(ts) // 1000 as started_ms, user_id || '-' || (epoch_us(ts) // 1000 // {7 * DAY_MS}) as session_id, 'agent-' || (user_id % 12) as agent_id,
      cast(round_even(value * 60, 0) as bigint) as duration_ms, cast(json_extract_string(props, '$.k') as integer) as k,
      case event_type when 'click' then 'stt' when 'view' then 'llm' when 'purchase' then 'tts' when 'signup' then 'tool' else {_list(STAGES)}[event_id % 4 + 1] end as stage,
      case when event_type = 'error' then 'error' when event_id % 37 = 0 then 'cancelled' else 'ok' end as status,
      case when event_type = 'error' then {_list(ERROR_NAMES)}[event_id % 5 + 1] end as error_name, {_list(PROVIDERS)}[event_id % 7 + 1] as provider
    from events) bound
)"""

#: Turn facts as operators.facts.turn_facts() makes them of operations.
TURNS_SQL = """
turns as (
  select session_id, turn_id, any_value(agent_id) as agent_id, min(started_ms) as started_ms, max(ended_ms) as ended_ms, max(ended_ms) - min(started_ms) as duration_ms,
    case when bool_or(failed) then 'error' when bool_or(interrupted) then 'cancelled' else 'ok' end as status,
    case when max(case when stage in ('llm', 'tts') then duration_ms end) >= 250 then max(case when stage in ('llm', 'tts') then duration_ms end) end as response_ms,
    count(*) filter (stage = 'stt') as stt_ops, count(*) filter (stage = 'llm') as llm_ops, count(*) filter (stage = 'tts') as tts_ops, count(*) filter (stage = 'tool') as tool_ops,
    count(*) filter (stage = 'stt' and failed) as stt_failed, count(*) filter (stage = 'llm' and failed) as llm_failed, count(*) filter (stage = 'tts' and failed) as tts_failed, count(*) filter (stage = 'tool' and failed) as tool_failed,
    count(*) filter (stage = 'tts' and interrupted) as tts_interrupted, min(case when stage = 'stt' then provider end) as stt_provider, min(case when stage = 'llm' then provider end) as llm_provider, min(case when stage = 'tts' then provider end) as tts_provider
  from (select *, status = 'error' and coalesce(error_name not in ('AbortError', 'CancelledError', 'CancelledException'), true) as failed,
    status = 'cancelled' or (status = 'error' and coalesce(error_name in ('AbortError', 'CancelledError', 'CancelledException'), false)) as interrupted from ops) o
  group by session_id, turn_id
), calls as (
  select session_id, any_value(agent_id) as agent_id, min(started_ms) as started_ms, max(ended_ms) - min(started_ms) as duration_ms, count(*) as turns,
    sum(stt_failed + llm_failed + tts_failed + tool_failed)::bigint as failed_ops, sum(tts_interrupted)::bigint as interrupted, count(*) filter (response_ms >= 3000) as lag_turns,
    count(response_ms) as measured, max(response_ms) as max_response_ms, sum(stt_failed)::bigint as stt_failed, sum(llm_failed)::bigint as llm_failed, sum(tts_failed)::bigint as tts_failed, sum(tool_failed)::bigint as tool_failed
  from turns group by session_id
)"""
