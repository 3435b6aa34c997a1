"""Star-schema tables bound to session packages: every event becomes a turn of spans.

``lines`` gives the events.jsonl lines that a call of the bound events would have, with
what real captures lack or repeat: turns without words, finals that never came or came
twice, transport attempts beside model calls, audio known only from received chunks,
sockets, split turns. ``NESTED_SQL`` says in DuckDB what each turn should measure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmetrics.operators import calls
from callmetrics.sources.binding import DAY_MS, OPERATIONS_SQL, operations, table
from callmetrics.sources.packages import MANIFEST, RUN, audio_chunks_in, chunk_of, manifests_of, opened_lines, operations_in, parsed_lines, rejected_in, runs_of
from callmetrics.sources.shared import shared_path

WEEK_MS = 7 * DAY_MS


def _at(offset: str, *more: str) -> str:
    return f"named_struct('occurred_at_ms', double({offset}){''.join(', ' + m for m in more)})"


_SPANS = {
    "stt": ("true", f"""named_struct('event_id', concat(e, '-stt'), 'session_id', session_id, 'turn_id', string(e), 'scope', 'turn', 'type', 'stt', 'provider', provider, 'model', ' Nova-2 ', 'started_at_ms', b, 'ended_at_ms', b + 1200, 'duration_ms', 1200, 'status', 'ok',
        'request', named_struct('endpointing_ms', 300), 'response', named_struct('transcript', 'hello', 'final_reason', if(e % 9 = 0, 'manual_flush', 'speech_final'), 'confidence', 0.9,
        'words', if(e % 5 <> 0, array(named_struct('text', 'hello', 'type', 'word', 'start_ms', b + 100, 'end_ms', b + if(e % 23 = 0, 1200 + v, 800))), null), 'continues_turn', if(e % 13 = 0, string(before), null), 'reply_skipped', if(e % 19 = 0, 'callback_error', null)),
        'milestones', named_struct('speech_started', {_at("b")}, 'first_partial', {_at("b + 300")}, 'speech_ended', {_at("b + 800")}, 'final_transcript', if(e % 7 = 0, null, if(e % 11 = 0, {_at("b + 900", "'last_at_ms', double(b + 1000)", "'count', 2")}, {_at("b + 900", "'last_at_ms', double(null)", "'count', 1")}))),
        'samples', named_struct('partial', named_struct('items', array(named_struct('occurred_at_ms', double(b + 300), 'transcript', 'hel')), 'truncated', e % 21 = 0)))"""),
    "llm": ("true", f"""named_struct('event_id', concat(e, '-llm'), 'session_id', session_id, 'turn_id', string(e), 'scope', 'turn', 'type', 'llm', 'provider', 'azure openai', 'model', 'GPT', 'started_at_ms', b + 1200, 'ended_at_ms', b + 1200 + v, 'duration_ms', v, 'status', status,
        'error', if(status = 'error', named_struct('name', error_name, 'message', 'llm_error'), null), 'response', named_struct('prompt_tokens', v % 100, 'completion_tokens', v % 50, 'total_tokens', v % 100 + v % 50),
        'milestones', named_struct('first_token', if(e % 3 <> 0, {_at("b + 1400")}, null)))"""),
    "try": ("e % 4 = 0", """named_struct('event_id', concat(e, '-try'), 'session_id', session_id, 'turn_id', string(e), 'scope', 'turn', 'type', 'llm', 'started_at_ms', b + 1200, 'ended_at_ms', b + 1210, 'duration_ms', 10, 'status', 'ok')"""),
    "tts": ("stage <> 'stt'", f"""named_struct('event_id', concat(e, '-tts'), 'session_id', session_id, 'turn_id', string(e), 'scope', 'turn', 'type', 'tts', 'endpoint_id', 'elevenlabs-tts', 'started_at_ms', b + 1200 + v, 'ended_at_ms', b + 1900 + v, 'duration_ms', 700, 'status', if(e % 10 = 0, 'cancelled', 'ok'),
        'request', named_struct('derived_from', if(e % 12 = 0, 'playout', null)), 'response', named_struct('audio_ms', if(e % 2 = 1, 600.0, null), 'reply_attribution', if(e % 17 = 0, 'inferred', null)), 'milestones', named_struct('audio_chunk', if(e % 6 <> 0, {_at("b + 1600 + v")}, null)))"""),
    "tool": ("stage = 'tool'", """named_struct('event_id', concat(e, '-tool'), 'session_id', session_id, 'turn_id', string(e), 'scope', 'turn', 'type', 'tool', 'endpoint_id', 'tools', 'started_at_ms', b + 1300, 'ended_at_ms', b + 1300 + v, 'duration_ms', v, 'status', if(e % 8 = 0, 'error', 'ok'),
        'error', if(e % 8 = 0, named_struct('name', 'TimeoutError', 'message', 'x'), null), 'request', named_struct('name', tool_name))"""),
    "socket": ("e % 15 = 0", """named_struct('event_id', concat(e, '-socket'), 'session_id', session_id, 'scope', 'connection', 'type', 'stt', 'started_at_ms', b, 'ended_at_ms', b + 5000, 'duration_ms', 5000, 'status', 'cancelled')"""),
    "own_chunk": ("stage <> 'stt' and e % 6 = 1", """named_struct('kind', 'audio_chunk', 'session_id', session_id, 'track', 'agent', 'occurred_at_ms', double(b + 1640 + v), 'playout_at_ms', double(b + 1650 + v), 'duration_ms', 300.0, 'operation_id', concat(e, '-tts'))"""),
    "loose_chunk": ("stage <> 'stt' and e % 6 = 0", """named_struct('kind', 'audio_chunk', 'session_id', session_id, 'track', 'agent', 'occurred_at_ms', double(b + 1700 + v), 'duration_ms', 200.0)"""),
}


def turns_bound(spark: SparkSession, d: str) -> DataFrame:
    """(e, b, v, ...): number, start within its call and a length of each event. Calls are
    dealt to as many tasks as the session shuffles to, however small the events are: what
    is made of them is much larger."""
    before = F.lag("op_id").over(Window.partitionBy("session_id").orderBy("started_ms", "op_id"))
    return operations(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id").withColumn("before", before).withColumn("e", F.col("op_id")).withColumn("b", F.col("started_ms") % WEEK_MS).withColumn("v", F.col("duration_ms"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(package, value): the lines of all calls' event logs."""
    made = F.array(*(F.expr(f"if({when}, to_json({what}), null)") for when, what in _SPANS.values()))
    return turns_bound(spark, d).select(F.col("session_id").alias("package"), F.explode(F.array_compact(made)).alias("value"))


_STORED: dict[tuple[str, ...], str] = {}


def _state(spark: SparkSession, d: str) -> str:
    """What tells the events of a folder from those that were there at another time."""
    files = spark.read.format("binaryFile").load(f"{d}/events.parquet")  # as they are listed, none is opened
    return str(files.agg(F.count("*"), F.max("modificationTime"), F.sum("length"), F.max("length"), F.max("path")).first())


def _key(spark: SparkSession, d: str, name: str) -> tuple[str, ...]:
    return (spark.sparkContext.applicationId, d, name, _state(spark, d))


def stored(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the events of the folder ``d``, written once a session beside the
    checkpoints, and again where the folder has changed since."""
    key = _key(spark, d, name)
    if key not in _STORED:
        path = f"{shared_path(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "parsed", lambda: parsed_lines(lines(spark, d)))


def spans_of(spark: SparkSession, d: str) -> DataFrame:
    parsed = _parsed(spark, d)
    return operations_in(parsed, stored(spark, d, "rejected", lambda: rejected_in(parsed)))


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return audio_chunks_in(_parsed(spark, d))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """(package, chunk, whole, ...): lines with what is measured of each span in its place.
    They are parsed for it, unless this session has written them parsed already. Chunks are
    parsed last: Spark compiles the step that does so in small methods, which the JVM optimises."""
    if _key(spark, d, "parsed") in _STORED:
        return calls.measured_spans(_parsed(spark, d).select("package", "chunk", "whole", "op.*"), "package", "chunk", "whole")
    opened = opened_lines(lines(spark, d)).select("package", "text", "whole", "op.*")
    return calls.measured_spans(opened, "package", chunk_of(F.col("text")).alias("chunk"), "whole")


def measured_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(measured spans, audio chunks), from one table of measured lines: what turns, calls,
    tools and failures are made of."""
    told = stored(spark, d, "measured", lambda: _measured(spark, d))
    rejected = stored(spark, d, "rejected", lambda: rejected_in(told))
    own = told.filter("type is not null").join(rejected, "package", "left_anti")
    return own.drop("package", "chunk", "whole"), audio_chunks_in(told)


def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    """(package, value): the manifest of each call as JSON text."""
    calls = turns_bound(spark, d).groupBy("session_id").agg(F.max("agent_id").alias("agent_id"), F.min("e").alias("m"), F.max("e").alias("x"), F.first(F.expr(f"started_ms div {WEEK_MS} * {WEEK_MS}")).alias("began"))
    text = F.expr("""to_json(named_struct('schema_version', '1.0', 'session_id', session_id, 'agent_id', agent_id, 'started_at', date_format(timestamp_millis(began), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), 'duration_ms', x - m, 'outcome', if(m % 3 = 0, null, 'completed'),
        'sdk', named_struct('language', if(m % 2 = 0, 'python', ' '), 'version', '1.2'), 'metadata', if(m % 4 = 0, map('env', 'staging'), if(m % 4 = 1, map('environment', 'production', 'version', '7'), null)),
        'capture_status', named_struct('events_complete', m % 5 <> 0, 'audio_complete', true, 'coverage_complete', m % 7 <> 0, 'dropped_event_count', if(m % 11 = 0, 3, 0)),
        'audio', map('user', named_struct('file', 'user.wav', 'channels', 1), 'agent', named_struct('file', 'agent.wav', 'channels', 1))))""")
    return calls.select(F.col("session_id").alias("package"), text.alias("value"))


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests read from that text as packages are."""
    return stored(spark, d, "manifests", lambda: manifests_of(manifest_lines(spark, d).select(F.from_json("value", MANIFEST).alias("m")).select("m.*")))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Challenger runs: turns of conversations as words, two runs of every third call."""
    told = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))  # one call's turns
    told = told.withColumn("kind", F.explode(F.expr("if(conv_id % 3 = 0, array('streaming', 'batch'), array(if(conv_id % 2 = 0, 'batch', null)))")))
    text = F.expr("""to_json(named_struct('session_id', string(conv_id), 'created_at', concat('2026-01-0', if(kind = 'streaming', 1, 2)), 'provider', 'deepgram', 'model', if(conv_id % 10 = 7, null, 'nova'), 'kind', kind, 'status', if(conv_id % 5 = 4, 'failed', 'complete'),
        'response', named_struct('words', if(kind = 'streaming', array(), transform(said, (s, i) -> named_struct('text', s.text, 'start', i * 1.5, 'end', i * 1.5 + 1))))))""")
    return runs_of(told.select(F.from_json(text, RUN).alias("r")).select("r.*"))


#: heard: what each turn's rules give, on the call's clock (b: its start there).
NESTED_SQL = f"""with {OPERATIONS_SQL}, bound as (
  select *, op_id as e, started_ms % {WEEK_MS} as b, duration_ms as v, lag(op_id) over (partition by session_id order by started_ms, op_id) as before from ops
), chunks as (
  select session_id, b + 1640 + v as came from bound where stage <> 'stt' and e % 6 = 1 union all select session_id, b + 1700 + v from bound where stage <> 'stt' and e % 6 = 0
), received as (
  select t.e, min(c.came) as came from bound t join chunks c on c.session_id = t.session_id and c.came between t.b + 1200 + t.v and t.b + 1900 + t.v where t.stage <> 'stt' and t.e % 6 = 0 group by t.e
), timed as (
  select t.*, e % 5 <> 0 as worded, e % 7 <> 0 and e % 11 = 0 as twice, case when e % 5 <> 0 then case when e % 23 = 0 then 1200 + v else 800 end when e % 7 <> 0 and e % 11 = 0 then 1000 else 800 end as spoke_until,
    case when e % 7 = 0 then null when e % 11 = 0 then 1000 else 900 end as final, case when e % 7 <> 0 and e % 11 = 0 then 1000 else 800 end as declared,
    case when stage = 'stt' then null when e % 6 = 1 then 1650 + v when e % 6 = 0 then r.came - b else 1600 + v end as first_audio from bound t left join received r using (e)
), heard as (
  select * replace (e::varchar as turn_id), case when first_audio - spoke_until >= 250 then first_audio - spoke_until end as response_ms,
    case when status = 'error' or (stage = 'tool' and e % 8 = 0) or e % 19 = 0 then 'error' when status = 'cancelled' or (stage <> 'stt' and e % 10 = 0) then 'cancelled' else 'ok' end as turn_status,
    (status = 'error' and coalesce(error_name not in ('AbortError', 'CancelledError', 'CancelledException'), true)) as llm_failed, stage = 'tool' and e % 8 = 0 as tool_failed from timed
) """
