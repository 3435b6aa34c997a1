"""Session packages bound to the tables, from their lines to turns, calls and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import scalars, spans, text
from callmetrics.operators import calls, challenger, evaluation, facts, measures
from callmetrics.plans import reports
from callmetrics.plans.registry import query
from callmetrics.sources import nested, packages
from callmetrics.sources.binding import table
from callmetrics.sources.nested import NESTED_SQL

_VENDOR = "case provider when 'Deepgram' then 'deepgram' when 'deepgram-tts' then 'deepgram' when 'eastus.api.cognitive.microsoft.com' then 'azure-openai' when 'azure openai' then 'azure-openai' when 'My Vendor' then 'my-vendor' end"


def stt_of(spark, d):
    """Recognition spans of turns with their speech window, capture profile and timing."""
    ops = calls.in_turns(nested.spans_of(spark, d)).filter("type = 'stt'")
    return calls.timed(ops)


def turns_of(spark, d):
    return nested.stored(spark, d, "turns", lambda: calls.measured_turns(*nested.measured_of(spark, d), nested.manifests(spark, d)))


@query("S01_read_operations", NESTED_SQL + "select type, count(*) as n from (select unnest(list_filter(['stt', 'llm', case when e % 4 = 0 then 'llm' end, case when stage <> 'stt' then 'tts' end, case when stage = 'tool' then 'tool' end, case when e % 15 = 0 then 'stt' end], lambda x: x is not null)) as type from bound) t group by 1")
def s01(spark, d):
    return nested.spans_of(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("S02_read_audio_chunks", NESTED_SQL + "select session_id, count(*) as chunks, min(came)::double as first_ms from chunks group by 1")
def s02(spark, d):
    return nested.chunks_of(spark, d).groupBy("session_id").agg(F.count("*").alias("chunks"), F.min("occurred_at_ms").alias("first_ms"))


@query("S03_read_manifests", NESTED_SQL + "select session_id, max(agent_id) as agent_id, case when min(e) % 3 = 0 then 'unknown' else 'completed' end as outcome, case min(e) % 4 when 0 then 1 when 1 then 2 else 0 end as labels from bound group by 1")
def s03(spark, d):
    return nested.manifests(spark, d).select("session_id", "agent_id", "outcome", F.size("metadata").alias("labels"))


RUNS_SQL = "with told as (select conv_id, unnest(case when conv_id % 3 = 0 then ['streaming', 'batch'] else [case when conv_id % 2 = 0 then 'batch' end] end) as kind, count(*) as n from conversations where text is not null group by conv_id), runs as (select conv_id::varchar as session_id, coalesce(kind, 'batch') as kind, case when kind = 'streaming' then 1 else 2 end as day, case when kind = 'streaming' then 0 else n end as words, conv_id from told where conv_id % 10 <> 7) "


@query("S04_read_challenger_runs", RUNS_SQL + "select session_id, kind, words::integer as words, row_number() over (partition by session_id order by day desc)::integer as recency, case when words > 0 then (words - 1) * 1500.0 end::double as last_start from runs")
def s04(spark, d):
    return nested.runs(spark, d).select("session_id", "kind", F.size("words").alias("words"), "recency", F.try_element_at("words", F.lit(-1))["start_ms"].alias("last_start"))


@query("W10_selected_run", RUNS_SQL + "select session_id, kind from (select *, row_number() over (partition by session_id order by case when words > 0 then 1 else 2 end, day desc) as n from runs where conv_id % 5 <> 4) where n = 1")
def w10(spark, d):
    return challenger.selected_run(nested.runs(spark, d)).select("session_id", "kind")


@query("S08_verify_objects", "select doc_id::varchar as path, case when doc_id % 3 = 0 then 'missing' when doc_id % 5 = 0 then 'size' else 'checksum' end as reason from documents where text is not null and (doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0)")
def s08(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumn("path", F.col("doc_id").cast("string")).withColumn("content", F.col("text").cast("binary"))
    size = F.octet_length("text").cast("long")
    declared = docs.select("path", F.when(F.col("doc_id") % 5 == 0, size + 1).otherwise(size).alias("bytes"), F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return packages.verify_objects(docs.filter("doc_id % 3 <> 0").select("path", size.alias("length"), "content"), declared).select("path", "reason")


@query("S09_recordings", NESTED_SQL + "select session_id, unnest(['user', 'agent']) as track, unnest([true, min(e) % 2 = 0]) as present from bound group by 1")
def s09(spark, d):
    found = nested.turns_bound(spark, d).groupBy("session_id").agg(F.min("e").alias("m")).select("session_id", F.explode(F.expr("if(m % 2 = 0, array('user.wav', 'agent.wav'), array('user.wav'))")).alias("file"), F.lit(10).alias("length"))
    return packages.recordings_inventory(nested.manifests(spark, d), found).select("session_id", "track", "present")


@query("P01_milestone_ms", NESTED_SQL + "select turn_id, (b + 300)::bigint as partial_ms, case when e % 7 <> 0 then b + 900 end as final_ms from heard")
def p01(spark, d):
    return stt_of(spark, d).select("turn_id", spans.milestone_ms("first_partial").alias("partial_ms"), spans.milestone_ms("speech_final", "final_transcript").alias("final_ms"))


@query("P02_repeated_milestone", NESTED_SQL + "select turn_id, case when twice then b + 1000 end as last_ms from heard")
def p02(spark, d):
    return stt_of(spark, d).select("turn_id", spans.repeated_milestone_last_ms(*spans.FINAL).alias("last_ms"))


@query("P05_capture_profile", NESTED_SQL + "select turn_id, true as transcript_recorded, worded as words_recorded, true as partials_recorded, true as speech_end_recorded, e % 7 <> 0 as final_recorded from heard")
def p05(spark, d):
    return stt_of(spark, d).select("turn_id", *(f"profile.{c}" for c in ("transcript_recorded", "words_recorded", "partials_recorded", "speech_end_recorded", "final_recorded")))


@query("P06_word_bounds", NESTED_SQL + "select turn_id, case when worded then b + 100 end as first, case when worded then b + spoke_until end as last from heard")
def p06(spark, d):
    return stt_of(spark, d).select("turn_id", spans.word_bounds().alias("w")).select("turn_id", "w.first", "w.last")


@query("P07_speech_window", NESTED_SQL + "select turn_id, b + case when worded then 100 else 0 end as start_ms, b + spoke_until as end_ms, worded as from_word_timestamps, twice and not worded as end_from_repeated_finals from heard")
def p07(spark, d):
    return stt_of(spark, d).select("turn_id", *(f"window.{c}" for c in ("start_ms", "end_ms", "from_word_timestamps", "end_from_repeated_finals")))


@query("P08_turn_latency", NESTED_SQL + """select turn_id, 300 - case when worded then 100 else 0 end as time_to_first_partial_ms, case when final <> declared then final - declared end as endpoint_delay_ms, case when worded and final >= spoke_until then final - spoke_until end as final_from_last_word_ms,
    case when worded then declared - spoke_until end as endpoint_position_error_ms, e % 7 = 0 as missing_final, e % 9 = 0 as forced_flush, case when final is null or final = declared then 'final_transcript_milestone_not_recorded' end as endpoint_unmeasurable_reason, e % 21 = 0 as partials_truncated, 1 as partial_count from heard""")
def p08(spark, d):
    names = ("time_to_first_partial_ms", "endpoint_delay_ms", "final_from_last_word_ms", "endpoint_position_error_ms", "missing_final", "forced_flush", "endpoint_unmeasurable_reason", "partials_truncated", "partial_count")
    return stt_of(spark, d).select("turn_id", *(f"m.{c}" for c in names))


@query("P09_presentation_window", NESTED_SQL + """select turn_id, 'stt' as type, b + case when worded then 100 else 0 end as from_ms, b + spoke_until as to_ms, case when worded then 'word_timestamps' when twice then 'final_transcripts' else 'speech_milestones' end as source from heard
    union all select turn_id, 'tts', case when e % 6 = 1 then b + 1650 + v when e % 2 = 1 then b + 1600 + v end, case when e % 6 = 1 then b + 1950 + v when e % 2 = 1 then b + 2200 + v end, case when e % 6 = 1 then 'attributed_audio_chunks' when e % 2 = 1 then 'inferred_response_audio_duration' end from heard where stage <> 'stt'""")
def p09(spark, d):
    shown = calls.presentation_windows(calls.in_turns(nested.spans_of(spark, d)), nested.chunks_of(spark, d))
    return shown.filter("type in ('stt', 'tts')").select("turn_id", "type", "shown.from_ms", "shown.to_ms", "shown.source")


@query("P14_llm_ttft", NESTED_SQL + "select e || '-llm' as event_id, case when e % 3 <> 0 then 200 end as ttft_ms from heard")
def p14(spark, d):
    return nested.spans_of(spark, d).filter("type = 'llm' and event_id like '%-llm'").select("event_id", spans.llm_ttft_ms().alias("ttft_ms"))


@query("P15_token_counts", NESTED_SQL + "select e || '-llm' as event_id, v % 100 as input, v % 50 as output from heard")
def p15(spark, d):
    return nested.spans_of(spark, d).filter("type = 'llm' and event_id like '%-llm'").select("event_id", spans.token_counts().alias("t")).select("event_id", "t.*")


@query("P24_capture_warnings", NESTED_SQL + "select session_id, array_to_string(list_filter([case when min(e) % 5 = 0 then 'events_incomplete' end, case when min(e) % 11 = 0 then 'events_dropped' end, case when min(e) % 7 = 0 then 'coverage_incomplete' end], lambda x: x is not null), ',') as warnings from bound group by 1")
def p24(spark, d):
    return nested.manifests(spark, d).select("session_id", F.array_join(spans.capture_warnings(), ",").alias("warnings"))


def _bodies(spark, d):
    """Chat requests that hold each call's turns."""
    said = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))  # one call's turns
    body = F.expr("to_json(named_struct('model', 'gpt', 'messages', transform(said, s -> named_struct('role', s.role, 'content', concat('{', s.text, '} \"', s.turn, '\"')))))")
    return said.select("conv_id", "said", body.alias("whole"))


@query("P25_salvaged_messages", "select conv_id, count(*)::integer - case when conv_id % 2 = 1 then 1 else 0 end as messages, min('{' || text || '} \"' || turn || '\"') filter (turn = t0) as first from (select *, min(turn) over (partition by conv_id) as t0 from conversations where text is not null) c group by conv_id")
def p25(spark, d):
    """Requests of odd calls are cut a few characters before their end."""
    bodies = _bodies(spark, d).withColumn("body", F.expr("if(conv_id % 2 = 1, left(whole, length(whole) - 5), whole)"))
    found = bodies.select("conv_id", spans.salvaged_messages(F.col("body")).alias("m"), F.col("said")[0]["role"].alias("role0"))
    return found.select("conv_id", F.size("m").alias("messages"), F.array_min(F.transform(F.filter("m", lambda x: F.regexp_extract(x["content"], '"(\\d+)"$', 1) == F.regexp_extract(F.col("m")[0]["content"], '"(\\d+)"$', 1)), lambda x: x["content"])).alias("first"))


@query("P26_decoded_completion", "select conv_id, turn, role, text, 'stop' as finish_reason, case when turn % 2 = 0 then 7 end::bigint as total_tokens, case when turn % 3 = 0 then 'find:{\"q\":1}' else '' end as calls from conversations where text is not null")
def p26(spark, d):
    """Replies as one body for even turns and as a stream of two deltas for odd ones."""
    rows = table(spark, d, "conversations").filter("text is not null")
    whole = F.expr("""to_json(named_struct('choices', array(named_struct('index', 0, 'finish_reason', 'stop', 'message', named_struct('content', text, 'tool_calls', if(turn % 3 = 0, array(named_struct('id', 'a', 'function', named_struct('name', 'find', 'arguments', '{"q":1}'))), null)))), 'usage', named_struct('total_tokens', 7)))""")
    half = "cast(length(text) / 2 as int)"
    event = lambda content, more: f"""concat('data: ', to_json(named_struct('choices', array(named_struct('index', 0, 'delta', named_struct('content', {content}, 'tool_calls', if(turn % 3 = 0, array({more}), null)), 'finish_reason', if({content} = right(text, length(text) - {half}), 'stop', null))))))"""
    other = """concat('data: ', to_json(named_struct('choices', array(named_struct('index', 1, 'delta', named_struct('content', 'other'))))))"""
    stream = F.expr("concat_ws('\n\n', " + event(f"left(text, {half})", "named_struct('index', 4, 'function', named_struct('name', 'find', 'arguments', '{\"q\"'))") + ", " + other + ", " + event(f"right(text, length(text) - {half})", "named_struct('index', 4, 'function', named_struct('name', null, 'arguments', ':1}'))") + ", 'data: [DONE]')")
    found = rows.select("conv_id", "turn", "role", spans.decoded_completion(F.when(F.col("turn") % 2 == 0, whole).otherwise(stream)).alias("c"))
    return found.select("conv_id", "turn", "role", "c.text", "c.finish_reason", "c.total_tokens", F.array_join(F.transform("c.tool_calls", lambda t: F.concat_ws(":", t["name"], t["arguments"])), "|").alias("calls"))


@query("P27_reported_cost", "select conv_id, turn, role, case when turn % 3 <> 0 then turn * 0.25 end::double as cost from conversations")
def p27(spark, d):
    body = F.expr("case when turn % 3 = 1 then to_json(named_struct('usage', named_struct('cost', turn * 0.25))) when turn % 3 = 2 then to_json(named_struct('cost', turn * 0.25)) else '{\"usage\":{}}' end")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", spans.reported_cost(body).alias("cost"))


@query("P28_redacted_json", "select conv_id, turn, role, '{\"api_key\":\"[redacted]\",\"inner\":{\"note\":\"use [redacted] now\",\"said\":' || to_json(coalesce(text, '')) || ',\"password\":\"[redacted]\"}}' as body, 2 as secret_keys, 1 as secret_values from conversations where text is not null")
def p28(spark, d):
    """A body of every turn. No turn of the given tables holds a credential itself; tests hold those that do."""
    rows = table(spark, d, "conversations").filter("text is not null")
    inner = "to_json(named_struct('note', concat('use ', 'ghp_', repeat('a', 24), ' now'), 'said', text, 'password', 'p'))"
    body = F.expr(f"concat('{{\"api_key\":\"k\",\"inner\":', {inner}, '}}')")
    return rows.select("conv_id", "turn", "role", scalars.redact_json(body).alias("r")).select("conv_id", "turn", "role", F.col("r.text").alias("body"), "r.secret_keys", "r.secret_values")


@query("P32_repaired", NESTED_SQL + "select event_id, status, change from (select e || '-llm' as event_id, status, case when false then '' end as change from heard union all select e || '-socket', case when m % 3 <> 0 then 'ok' else 'cancelled' end, case when m % 3 <> 0 then 'closed_by_teardown' end from (select *, min(e) over (partition by session_id) as m from heard) h where e % 15 = 0) r")
def p32(spark, d):
    ops = nested.spans_of(spark, d).filter("event_id like '%-llm' or scope = 'connection'").join(nested.manifests(spark, d).select("session_id", "outcome"), "session_id")
    return ops.select("event_id", spans.repaired(F.col("outcome")).alias("r")).select("event_id", "r.status", "r.change")


@query("P35_turn_outcome", "select op, case op when 'not_captured' then 'notcaptured' when 'challenger_empty' then 'noref' when 'not_run' then 'noref' when 'possible_missed_speech' then 'noprod' else case when w = 0 then 'match' else 'diff' end end as outcome, count(*) as n from (select ['not_captured', 'challenger_empty', 'not_run', 'possible_missed_speech', 'evaluated'][event_id % 5 + 1] as op, event_id % 2 as w from events) e group by 1, 2")
def p35(spark, d):
    rows = table(spark, d, "events").select(F.expr("element_at(array('not_captured', 'challenger_empty', 'not_run', 'possible_missed_speech', 'evaluated'), cast(event_id % 5 as int) + 1)").alias("op"), (F.col("event_id") % 2).cast("double").alias("w"))
    return rows.withColumn("outcome", scalars.turn_outcome(F.col("op"), F.col("w"))).groupBy("op", "outcome").agg(F.count("*").alias("n"))


@query("P36_milestone_phases", NESTED_SQL + "select turn_id, case when e % 7 = 0 then 'speech_started,first_partial,speech_ended' else 'speech_started,first_partial,speech_ended,final_transcript' end as names, case when e % 7 = 0 then 800 else 900 end as last_offset from heard")
def p36(spark, d):
    found = stt_of(spark, d).withColumn("p", spans.milestone_phases("stt"))
    return found.select("turn_id", F.array_join("p.name", ",").alias("names"), F.try_element_at("p", F.lit(-1))["offset_ms"].alias("last_offset"))


@query("P37_audio_window", NESTED_SQL + "select turn_id, case when e % 6 <> 0 then b + 1600 + v end as start_ms, case when e % 6 <> 0 and e % 2 = 1 then b + 2200 + v end as end_ms from heard where stage <> 'stt'")
def p37(spark, d):
    return nested.spans_of(spark, d).filter("type = 'tts'").select("turn_id", spans.audio_window().alias("w")).select("turn_id", "w.start_ms", "w.end_ms")


@query("F08_stt_turn_spans", NESTED_SQL + "select session_id, count(*) as n from heard group by 1")
def f08(spark, d):
    return nested.spans_of(spark, d).filter(spans.is_stt_turn()).groupBy("session_id").agg(F.count("*").alias("n"))


@query("J07_package_llm_calls", NESTED_SQL + "select turn_id, 1::bigint as calls, v as llm_ms from heard")
def j07(spark, d):
    """Model calls of turns; transport attempts lie in the framework's span."""
    return calls.logical_llm_calls(nested.spans_of(spark, d)).groupBy("turn_id").agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("llm_ms"))


TURN_COLUMNS = """session_id, turn_id, b as started_at_ms, b + greatest(1200 + v, case when e % 4 = 0 then 1210 else 0 end, case when stage <> 'stt' then 1900 + v else 0 end, case when stage = 'tool' then 1300 + v else 0 end) as ended_at_ms, turn_status as status, response_ms,
    spoke_until - case when worded then 100 else 0 end as user_speech_ms, case when e % 19 = 0 then 'callback_error' end as reply_skipped, stage <> 'stt' and e % 17 = 0 as inferred_reply, case when worded then 200 end as stt_first_partial_ms,
    case when not worded then 'speech_onset_not_observed' end as stt_first_partial_unmeasurable_reason, case when final <> declared then final - declared end as stt_endpoint_delay_ms, case when worded and final >= spoke_until then final - spoke_until end as stt_final_ms,
    e % 7 = 0 as stt_missing_final, e % 9 = 0 as stt_forced_flush, case when e % 3 <> 0 then 200 end as llm_ttft_ms, v as llm_completion_ms, v % 100 as llm_input_tokens, v % 50 as llm_output_tokens, nullif(v, 0) as llm_ms, 1 as llm_calls,
    case when stage <> 'stt' and e % 6 <> 0 then 400 end as tts_first_audio_ms, case when stage <> 'stt' and e % 12 <> 0 then 700 end as tts_synthesis_ms, case when stage = 'stt' then null when e % 6 = 1 then 300 when e % 2 = 1 then 600 end as audible_tts_ms,
    case when stage = 'tool' then v end as tool_total_ms, 1 as stt_ops, case when e % 4 = 0 then 2 else 1 end as llm_ops, (stage <> 'stt')::integer as tts_ops, (stage = 'tool')::integer as tool_ops, 0 as stt_failed, llm_failed::integer as llm_failed, 0 as tts_failed,
    tool_failed::integer as tool_failed, (stage <> 'stt' and e % 10 = 0)::integer as tts_interrupted, """ + f"{_VENDOR} as stt_provider, 'nova-2' as stt_model, 'azure-openai' as llm_provider, 'gpt' as llm_model, case when stage <> 'stt' then 'elevenlabs' end as tts_provider, case when e % 13 = 0 then before::varchar end as continues_turn, agent_id, started_ms"


@query("A08_package_turn_metrics", NESTED_SQL + f"select {TURN_COLUMNS} from heard")
def a08(spark, d):
    """Every measurement of every turn, from the lines of its package."""
    names = """session_id turn_id started_at_ms ended_at_ms status response_ms user_speech_ms reply_skipped inferred_reply stt_first_partial_ms stt_first_partial_unmeasurable_reason stt_endpoint_delay_ms stt_final_ms stt_missing_final
        stt_forced_flush llm_ttft_ms llm_completion_ms llm_input_tokens llm_output_tokens llm_ms llm_calls tts_first_audio_ms tts_synthesis_ms audible_tts_ms tool_total_ms stt_ops llm_ops tts_ops tool_ops stt_failed llm_failed tts_failed tool_failed
        tts_interrupted stt_provider stt_model llm_provider llm_model tts_provider continues_turn agent_id started_ms""".split()
    return turns_of(spark, d).select(*names)


FOLDED = NESTED_SQL.replace("with ", "with recursive ", 1) + """, walk as (select session_id, e, e as root from heard where not (e % 13 = 0 and before is not null) union all select h.session_id, h.e, w.root from heard h join walk w on h.e % 13 = 0 and h.before = w.e and h.session_id = w.session_id),
    folded as (select h.*, w.root, h.e <> w.root as is_continuation from heard h join walk w on w.e = h.e) """


@query("A13_package_splits", FOLDED + "select turn_id, is_continuation, not is_continuation and count(*) over x > 1 as has_continuation, not is_continuation and count(*) over x > 1 as stt_split, not is_continuation and count(*) filter (stage = 'tool') over x > 1 as tool_split from folded window x as (partition by root)")
def a13(spark, d):
    return turns_of(spark, d).select("turn_id", "is_continuation", "has_continuation", "stt_split", "tool_split")


CALLS_CTE = """manifests as (select session_id, min(e) as m, max(e) as x, max(agent_id) as agent_id from bound group by 1), owned as (select session_id, count(*) filter (not is_continuation) as turns, count(distinct case when stage <> 'stt' and e % 17 = 0 then root end) as inferred_reply_turns, 0 as stt_failed, sum(llm_failed::integer)::bigint as llm_failed, 0 as tts_failed, sum(tool_failed::integer)::bigint as tool_failed,
    sum(llm_failed::integer + tool_failed::integer)::bigint as failed_ops, count(*) filter (response_ms >= 3000) as lag_turns, count(response_ms) as measured, count(*) filter (e % 7 = 0) as missing_final_turns, max(response_ms) as max_response_ms, any_value(started_ms - b) as started_ms from folded group by 1),
  cf as (select session_id, m.agent_id, case when m % 4 = 0 then 'staging' when m % 4 = 1 then 'production' end as environment, case when m % 4 = 1 then '7' end as agent_version, case when m % 2 = 0 then 'python' end as sdk_language, started_ms, x - m as duration_ms, case when m % 3 = 0 then 'unknown' else 'completed' end as outcome,
    case when m % 7 <> 0 then 'ready' else 'partial' end as status, turns, inferred_reply_turns, stt_failed, llm_failed, tts_failed, tool_failed, failed_ops, lag_turns, measured, missing_final_turns, max_response_ms, m % 5 = 0 or m % 11 = 0 as capture_incomplete from manifests m join owned using (session_id))"""


def calls_of(spark, d):
    return calls.call_metrics(turns_of(spark, d), nested.manifests(spark, d), nested.measured_of(spark, d)[0])


@query("A09_package_call_metrics", FOLDED + ", " + CALLS_CTE + " select * from cf")
def a09(spark, d):
    return calls_of(spark, d).select("session_id", "agent_id", "environment", "agent_version", "sdk_language", "started_ms", "duration_ms", "outcome", "status", "turns", "inferred_reply_turns", *(f"{s}_failed" for s in facts.STAGES), "failed_ops", "lag_turns", "measured", "missing_final_turns", "max_response_ms", "capture_incomplete")


@query("A10_package_tools", NESTED_SQL + "select coalesce(tool_name, 'tools') as tool_name, count(*) as invocations, count(*) filter (e % 8 = 0) as failed, count(*) filter (e % 8 = 0) as timed_out from heard where stage = 'tool' group by 1")
def a10(spark, d):
    return measures.tool_summary(calls.tool_metrics(nested.spans_of(spark, d))).select("tool_name", "invocations", "failed", "timed_out")


@query("A11_package_failures", NESTED_SQL + "select fingerprint, stage, count(*) as n from (select 'llm:' || coalesce(error_name, 'UnknownError') as fingerprint, 'llm' as stage from heard where llm_failed union all select 'tool:TimeoutError', 'tool' from heard where tool_failed) f group by 1, 2")
def a11(spark, d):
    found = calls.failure_metrics(nested.spans_of(spark, d), nested.manifests(spark, d))
    return measures.failure_summary(found, limit=None).select("fingerprint", "stage", "n")


@query("J14_paired_deltas", NESTED_SQL + """select metric, count(*) as n, round(quantile_cont(x, 0.5), 6)::double as p50, round(quantile_cont(x, 0.9), 6)::double as p90, min(x) as least, max(x) as greatest from (
    select 'first_partial_ms' as metric, v % 700 - 200 as x from heard where worded and e % 4 <> 1 union all select 'endpoint_delay_ms', v % 900 - (final - spoke_until) from heard where worded and final >= spoke_until) p group by 1""")
def j14(spark, d):
    """Recognition as captured against a challenger of the same turns."""
    production = stt_of(spark, d).select("session_id", "turn_id", F.when(F.col("m.region_from_word_timestamps"), F.col("m.time_to_first_partial_ms")).alias("time_to_first_partial_ms"), "m.final_from_last_word_ms")
    other = nested.turns_bound(spark, d).select("session_id", F.col("e").cast("string").alias("turn_id"), F.expr("if(e % 4 = 1, null, v % 700)").alias("time_to_first_partial_ms"), F.expr("v % 900").alias("endpoint_delay_ms"))
    return evaluation.paired_deltas(production, other, []).select("metric", "n", "p50", "p90", "least", "greatest")


@query("J13_stream_latency")
def j13(spark, d):
    """Each turn's speech against what a paced replay of its call received."""
    windows = stt_of(spark, d).select("session_id", "turn_id", "window.start_ms", "window.end_ms", F.col("window.start_ms").alias("onset_ms"), F.col("window.from_word_timestamps").alias("onset_reliable"))
    own = nested.turns_bound(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("b", "e"))).alias("x"))  # one call's turns
    receipt = lambda kind, after, text, heard: F.transform("x", lambda s: F.struct(F.lit(kind).alias("kind"), (s["b"] + after).alias("at_ms"), (s["b"] + after).alias("audio_cursor_ms"), F.lit(text).alias("text"), (s["b"] + heard).alias("result_audio_end_ms")))
    receipts = F.sort_array(F.concat(receipt("partial_transcript", 350, "hel", 250), receipt("partial_transcript", 600, "hello", 500), receipt("committed_transcript", 1000, "hello", 800)), True)
    ordered = F.array_sort(receipts, lambda l, r: (l["at_ms"] - r["at_ms"]).cast("int"))
    commits = F.transform(F.filter("x", lambda s: s["e"] % 6 != 0), lambda s: F.struct((s["b"] + 1000).alias("at_ms"), F.lit("hello").alias("text"), (s["b"] + 100).alias("audio_start_ms"), (s["b"] + 850).alias("audio_end_ms")))
    runs = own.select("session_id", F.struct(ordered.alias("receipts"), F.when(F.hash("session_id") % 2 == 0, commits).otherwise(F.slice(commits, 1, 0)).alias("commits")).alias("timing"))
    return challenger.stream_latency(windows, runs)


@query("X08_words_to_text", "select conv_id, string_agg(trim(text), ' ' order by turn, role) as text from conversations where text is not null group by 1")
def x08(spark, d):
    said = table(spark, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))  # one call's turns
    return said.select("conv_id", text.words_to_text(F.col("said.text")).alias("text"))


@query("W08_rebased_segments", NESTED_SQL + "select session_id, count(*) as segments, sum(v % 900 + 100)::double as spoken_ms, true as in_order from bound group by 1")
def w08(spark, d):
    """Segments whose clocks restart at every event, put on one clock."""
    own = nested.turns_bound(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("b", "e", F.expr("double(v % 900 + 100)").alias("n")))).alias("x"))  # one call's segments
    segments = F.transform("x", lambda s: F.struct(F.lit(0.0).alias("start_ms"), s["n"].alias("end_ms"), (s["b"] + s["n"]).cast("double").alias("cursor_ms")))
    placed = own.select("session_id", challenger.rebased_segments(segments).alias("r"))
    late = F.exists(F.arrays_zip(F.slice("r", 2, 1 << 30).alias("b"), F.slice("r", 1, F.size("r") - 1).alias("a")), lambda z: z["b"]["start_ms"] < z["a"]["end_ms"])
    return placed.select("session_id", F.size("r").cast("long").alias("segments"), F.aggregate("r", F.lit(0.0), lambda acc, s: acc + s["end_ms"] - s["start_ms"]).alias("spoken_ms"), (~late).alias("in_order"))
