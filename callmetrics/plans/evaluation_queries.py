"""Evaluation, backfill and continuous alerts over the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callmetrics.functions import text
from callmetrics.operators import challenger, evaluation, facts, measures, onboarding
from callmetrics.plans import reports
from callmetrics.plans.dashboard_queries import ALERT_SQL, FLAT
from callmetrics.plans.measure_queries import _SCORED_SQL, EDITS_SQL, _pairs, a25, scored_pairs, words_sql
from callmetrics.plans.package_queries import RUNS_SQL, j13, stt_of
from callmetrics.plans.registry import FACTS, OPS, query
from callmetrics.plans.scalar_queries import calls_of, turns_of
from callmetrics.sources import nested
from callmetrics.sources.binding import operations, table
from callmetrics.sources.nested import NESTED_SQL
from callmetrics.sources.packages import replaced
from callmetrics.sources.shared import shared_path


@query("W06_partial_revisions", "with spoken as (select conv_id, role, turn, " + words_sql("lower(text)") + """ as t, conv_id % 10 = 0 as truncated from conversations where text is not null),
    paired as (select *, lag(t) over (partition by conv_id, role order by turn) as before from spoken), asked as (select struct_pack(conv_id := conv_id, role := role, turn := turn) as k, before as l, t as r from paired where before is not null), """ + EDITS_SQL + """
    select p.conv_id, p.role, count(*) as hypotheses, case when not bool_or(truncated) then coalesce(sum(errors), 0)::bigint end as revisions from paired p left join recursive_edits e on e.k.conv_id = p.conv_id and e.k.role = p.role and e.k.turn = p.turn group by 1, 2""")
def w06(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "role", F.col("turn").alias("seq"), "text", (F.col("conv_id") % 10 == 0).alias("truncated"))
    return evaluation.partial_revisions(rows, ["conv_id", "role"])


@query("W11_transcript", "select session_id, role, text, min(op_id) as op_id, any_value(position) as position from (select conv_id as session_id, role, text, 0 as op_id, turn as position, row_number() over (partition by conv_id, role, text order by turn) as nth from conversations) m where not exists (select 1 from conversations l where m.role = 'assistant' and l.conv_id = m.session_id and l.role = 'assistant' and l.text <> m.text and starts_with(l.text, m.text) and m.text <> '') group by session_id, role, text, nth")
def w11(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "role", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("op_id"), F.col("turn").alias("position"))
    return evaluation.transcript(rows)


@query("A26_length_agreement", "select conv_id, count(*) as turns, sum(length(text))::bigint as production_chars, sum(length(text) + turn)::bigint as challenger_chars, round(sum(length(text)) / sum(length(text) + turn), 6) as ratio from conversations where text is not null and conv_id % 2 = 0 group by conv_id")
def a26(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null").select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.length("text")).alias("production_chars"), (F.length("text") + F.col("turn")).alias("challenger_chars"))
    return evaluation.length_agreement(rows, ["conv_id"])


_ERROR = "case when worded then declared - spoke_until else 0 end"


@query("A27_turn_shape", NESTED_SQL + f"""select session_id, count(*) as measured_turns, count(*) filter (e % 7 = 0) as missing_final, 0 as non_turn_final, count(*) filter ({_ERROR} < -1000) as premature, count(*) filter ({_ERROR} > 1000) as late, count(*) filter (e % 9 = 0) as forced, count(*) filter (abs({_ERROR}) > 1000) as split_or_merged,
    coalesce(string_agg(e::varchar, ',' order by e::varchar) filter (e % 7 = 0), '') as missing_final_turns, coalesce(string_agg(e::varchar, ',' order by e::varchar) filter ({_ERROR} < -1000), '') as premature_turns from heard group by 1""")
def a27(spark, d):
    turns = stt_of(spark, d).select("session_id", "turn_id", "m.missing_final", F.col("m.endpoint_position_error_ms").alias("position_error_ms"), "m.forced_flush", "m.is_turn_final")
    shape = evaluation.turn_shape(turns, ["session_id"])
    lists = ("missing_final_turns", "premature_turns")
    return shape.select("session_id", "measured_turns", "missing_final", "non_turn_final", "premature", "late", "forced", "split_or_merged", *(F.array_join(c, ",").alias(c) for c in lists))


@query("A28_response_budget", OPS + "select session_id, count(share) as n, round(quantile_cont(share, 0.5), 6) as share_p50, round(quantile_cont(w, 0.5), 6) as wait_p50 from (select session_id, case when e + l + t > 0 then e / (e + l + t) end as share, e + l + t + 100 - e + e * 0.5::double as w from (select session_id, turn_id, min(case when stage = 'stt' then duration_ms end) as e, min(case when stage = 'llm' then duration_ms end) as l, min(case when stage = 'tts' then duration_ms end) as t from ops group by 1, 2) p) q group by session_id")
def a28(spark, d):
    at = lambda s: F.min(F.when(F.col("stage") == s, F.col("duration_ms")))
    parts = operations(spark, d).groupBy("session_id", "turn_id").agg(at("stt").alias("endpoint_ms"), at("llm").alias("llm_ms"), at("tts").alias("tts_ms"))
    parts = parts.withColumn("wait_ms", F.col("endpoint_ms") + F.col("llm_ms") + F.col("tts_ms") + 100).withColumn("challenger_endpoint_ms", F.col("endpoint_ms") * 0.5)
    return evaluation.response_budget(parts, ["session_id"])


@query("A29_count_by", NESTED_SQL + "select session_id, case when e % 9 = 0 then 'manual_flush' else 'speech_final' end as value, count(*) as n from heard group by all")
def a29(spark, d):
    return evaluation.count_by(stt_of(spark, d), ["session_id"], "response.final_reason")


@query("A29_challenger_latency")
def a29_latency(spark, d):
    """What a paced replay of each call measured."""
    return evaluation.challenger_latency(j13(spark, d))


@query("A34_capabilities", NESTED_SQL + "select session_id, true as streaming_partials, bool_or(worded) as word_timestamps, false as vad_events, true as confidence_scores, 0 as languages, false as multilingual_turns, null::integer as sample_rate_hz from heard group by 1")
def a34(spark, d):
    return evaluation.production_capabilities(stt_of(spark, d)).withColumn("languages", F.size("languages"))


@query("A34_challenger_summary", RUNS_SQL + """, chosen as (select * from (select *, row_number() over (partition by session_id order by case when words > 0 then 1 else 2 end, day desc) as n from runs where conv_id % 5 <> 4) x where n = 1),
    replay as (select session_id from runs where kind = 'streaming' and conv_id % 5 <> 4)
    select session_id, 'deepgram' as provider, 'nova' as model, kind, '2026-01-0' || day as created_at, words::integer as word_count, words > 0 as word_timestamps, false as confidence_scores, case when r.session_id is not null then 'nova' end as streaming_model, coalesce(r.session_id is not null, false) as vad_events, coalesce(r.session_id is not null, false) as streaming_partials
    from chosen left join replay r using (session_id)""")
def a34_challenger(spark, d):
    runs = nested.runs(spark, d).filter("status = 'complete'")
    streaming = measures.newest(runs.filter("kind = 'streaming'"), ["session_id"], [F.col("recency")], 1)
    return evaluation.challenger_summary(challenger.selected_run(nested.runs(spark, d)), streaming, streaming)


@query("A34_run_metadata", RUNS_SQL.replace("with ", _SCORED_SQL.rstrip() + ", ", 1) + """, made as (select session_id, count(*) as runs, '2026-01-0' || min(day) as started_at, '2026-01-0' || max(day) as completed_at from runs group by 1)
    select *, case when runs = 0 then 'not_run' when completed_turns = 0 then 'failed' when completed_turns < eligible_turns then 'partial' else 'ready' end as state from (
      select t.session_id, eligible_turns, completed_turns, coalesce(runs, 0) as runs, started_at, completed_at from (select conv_id::varchar as session_id, count(*) as eligible_turns, count(*) filter (status = 'evaluated') as completed_turns from rated group by 1) t left join made using (session_id)) s""")
def a34_runs(spark, d):
    return evaluation.run_metadata(_scored(spark, d), nested.runs(spark, d)).select("session_id", "eligible_turns", "completed_turns", "runs", "started_at", "completed_at", "state")


#: Turns whose capture lacks its text, that no challenger ran on, or whose words fit several turns.
_LACKS = {"recorded": "turn % 7 <> 3", "ran": "conv_id % 6 <> 5", "ambiguous": "turn % 11 = 4"}
_STATUS = f"case when not ({_LACKS['recorded']}) then 'production_transcript_not_captured' when not ({_LACKS['ran']}) then 'challenger_not_run' when {_LACKS['ambiguous']} then 'challenger_mapping_ambiguous' else status end"


@query("X05_uncaptured_pairs", _SCORED_SQL + f"select conv_id, turn, role, {_STATUS} as status, case when {_STATUS} = status then errors else 0 end as errors, case when {_STATUS} = 'challenger_not_run' then 0 else words end as words, case when {_STATUS} = status then wer end::double as wer from rated")
def x05_uncaptured(spark, d):
    score = text.scored_pair(F.col("production"), F.col("challenger"), *(F.expr(when) for when in _LACKS.values()))
    return _pairs(spark, d).select("conv_id", "turn", "role", score.alias("s")).select("conv_id", "turn", "role", "s.status", "s.errors", "s.words", "s.wer")


@query("T04_worst_turns", _SCORED_SQL + "select session_id, turn_id, place::integer as place from (select conv_id::varchar as session_id, turn || '/' || role as turn_id, row_number() over (partition by conv_id order by coalesce(wer, 0) desc, turn || '/' || role) as place from rated where status in ('evaluated', 'possible_missed_speech')) t where place <= 5")
def t04(spark, d):
    scored = _scored(spark, d).withColumn("turn_id", F.concat_ws("/", F.col("turn").cast("string"), "role"))
    return evaluation.worst_turns(scored, ["session_id"]).select("session_id", "turn_id", "place")


@query("T04_top_disagreed_words")
def t04_words(spark, d):
    """Of each call, the twelve pairs of words that disagree most."""
    return a25(spark, d).filter("place <= 12")


@query("A39_stt_quality", OPS + "select session_id, count(*) as rows, count(tool) as transcripts, quantile_disc(duration_ms // 3, 0.5)::double as first_partial_p50, quantile_disc(duration_ms // 2, 0.5)::double as finalization_p50, case when count(distinct op_id % 2) = 1 then max(op_id % 2) end as endpointing_ms, count(distinct op_id % 2) > 1 as endpointing_varies from (select *, case when op_id % 4 > 0 then 'x' end as tool from ops where stage = 'stt') o group by session_id")
def a39(spark, d):
    rows = operations(spark, d).filter("stage = 'stt'").selectExpr("session_id", "case when op_id % 4 > 0 then 'x' end as transcript", "duration_ms div 3 as first_partial_ms", "duration_ms div 2 as finalization_ms", "op_id % 2 as endpointing_ms")
    return evaluation.stt_quality(rows, ["session_id"])


@query("T05_alert_order", FLAT + ALERT_SQL + "select rule, scope, row_number() over (order by scope <> 'fleet', case when state = 'firing' and sev = 'critical' then 0 when state = 'firing' then 1 else 2 end, case when state = 'firing' then round((observed::double - threshold::double) / threshold::double, 6) end desc nulls last, scope, rule)::integer as place from stated")
def t05(spark, d):
    return measures.placed(reports.alerts(turns_of(spark, d)), reports.alert_order()).select("rule", "scope", "place")


@query("T06_missing_last", FACTS + "select session_id, row_number() over (order by max_response_ms asc nulls last, session_id)::integer as place from calls")
def t06(spark, d):
    return measures.placed(calls_of(spark, d), [F.col("max_response_ms").asc_nulls_last(), F.col("session_id")]).select("session_id", "place")


@query("X10_risk_skip_reason", "select conv_id, turn, role, case when trim(coalesce(case when turn % 3 > 0 then text end, '')) = '' then 'challenger_empty' when trim(coalesce(case when turn % 2 > 0 then text end, '')) = '' then 'production_empty' when conv_id % 2 = 0 then 'no_difference' end as reason from conversations")
def x10(spark, d):
    rows = table(spark, d, "conversations")
    reason = text.risk_skip_reason(F.when(F.col("turn") % 2 > 0, F.col("text")), F.when(F.col("turn") % 3 > 0, F.col("text")), (F.col("conv_id") % 2).cast("double"))
    return rows.select("conv_id", "turn", "role", reason.alias("reason"))


def _scored(spark, d):
    return scored_pairs(spark, d).withColumn("session_id", F.col("conv_id").cast("string"))


@query("X12_call_report", _SCORED_SQL + "select conv_id::varchar as session_id, round(quantile_cont(wer, 0.5), 6)::double as median_wer, count(*) filter (wer >= 0.10) as moderate_or_worse, count(*) filter (wer > 0.25) as high from rated group by 1")
def x12(spark, d):
    return evaluation.call_report(_scored(spark, d), ["session_id"])


_RISK = "case turn % 5 when 0 then 'none' when 1 then 'low' when 2 then 'medium' when 3 then 'high' end"


@query("X11_evaluation_report", _SCORED_SQL + f"""select session_id, turns, scored, evaluated, errors, words, wer, case when wer is null then 'unavailable' when wer < 0.1 then 'low' when wer <= 0.25 then 'moderate' else 'high' end as band, band_low, band_high, p50, production, risk_high, risk_unavailable, outcome_risk_turns, round(s, 6) as share_below from (
    select conv_id::varchar as session_id, count(*) as turns, count(*) filter (status in ('evaluated', 'possible_missed_speech')) as scored, count(*) filter (status = 'evaluated') as evaluated, sum(errors) filter (status in ('evaluated', 'possible_missed_speech'))::bigint as errors, sum(words) filter (status in ('evaluated', 'possible_missed_speech'))::bigint as words,
      case when sum(words) > 0 then round(sum(errors) / sum(words), 6) end::double as wer, count(*) filter (wer < 0.1) as band_low, count(*) filter (wer > 0.25) as band_high from rated group by 1) a
    left join (select conv_id::varchar as session_id, round(quantile_cont(length(text) * 10, 0.5), 6)::double as p50, round(sum(length(text) * 10) / 60000 * 0.0048, 6)::double as production from conversations group by 1) b using (session_id)
    left join (select conv_id::varchar as session_id, count(*) filter (r = 'high') as risk_high, count(*) filter (r is null) as risk_unavailable, count(*) filter (r in ('high', 'medium')) as outcome_risk_turns from (select conv_id, {_RISK} as r from conversations) x group by 1) c using (session_id)
    left join (select session_id, cume_dist() over (partition by agent_id order by m) as s from (select conv_id::varchar as session_id, conv_id % 4 as agent_id, sum(length(text)) as m, row_number() over (partition by conv_id % 4 order by max(turn) desc, conv_id::varchar) as n from conversations group by conv_id) y where n <= 25 and m is not null) d using (session_id)""")
def x11(spark, d):
    said = table(spark, d, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))
    turns = said.select("session_id", (F.length("text") * 10).alias("response_ms"))
    costs = turns.groupBy("session_id").agg(F.round(F.sum("response_ms") / 60000 * 0.0048, 6).alias("production"))
    risk = evaluation.risks(said.select("session_id", F.expr(_RISK).alias("risk")), ["session_id"])
    size = said.groupBy("session_id", (F.col("conv_id") % 4).alias("agent_id")).agg(F.max("turn").alias("started_ms"), F.sum(F.length("text")).alias("m"))
    cohort = measures.cohort_rank(size, "m").select("session_id", "share_below", "typical")
    report = evaluation.evaluation_report(_scored(spark, d), measures.linear_percentiles(turns, ["session_id"], "response_ms"), costs, risk, cohort=cohort)
    names = [*(f"accuracy.{c}" for c in ("turns", "scored", "evaluated", "errors", "words", "wer", "band", "band_low", "band_high")), "latency.p50", "cost.production", *(f"risk.{c}" for c in ("risk_high", "risk_unavailable", "outcome_risk_turns")), "cohort.share_below"]
    return report.select("session_id", *names)


@query("E03_versioned_backfill", FACTS + "select session_id, turns, 7 as version from calls")
def e03(spark, d):
    """Stale rows (an older version) are rebuilt from turns, current ones kept."""
    now = calls_of(spark, d).select("session_id", "turns", F.lit(7).alias("version"))
    stored = now.withColumn("version", F.when(F.xxhash64("session_id") % 3 == 0, 6).otherwise(7)).withColumn("turns", F.when(F.col("version") == 6, F.lit(-1)).otherwise(F.col("turns")))
    rebuilt = now.join(stored.filter("version < 7").select("session_id"), "session_id", "left_semi")
    return replaced(stored, rebuilt, ["session_id"])


@query("E04_sketch_format", FACTS + "select 'dd-1' as format, count(*) as sketches from (select distinct agent_id from turns where response_ms is not null) t")
def e04(spark, d):
    """A tier whose format tag differs is written anew as a whole."""
    base = f"{shared_path(spark)}/e04-{uuid.uuid4().hex}"
    build = lambda tag: measures.sketch_build(turns_of(spark, d), ["agent_id"], "response_ms").withColumn("format", F.lit(tag)).write.mode("overwrite").parquet(base)
    build("dd-0")
    if spark.read.parquet(base).filter("format <> 'dd-1'").limit(1).count():
        build("dd-1")
    return spark.read.parquet(base).groupBy("format").agg(F.count_distinct("agent_id").alias("sketches"))


@query("E07_continuous_alerts", FLAT + ALERT_SQL + "select scope, calls, rule, state from stated")
def e07(spark, d):
    """Alerts over all turns so far, evaluated after every micro-batch from the sums before
    it and those of its own turns."""
    base = f"{shared_path(spark)}/e07-{uuid.uuid4().hex}"
    turns = facts.turn_facts(operations(spark, d))
    turns.repartition(2, "session_id").write.parquet(f"{base}/arrivals")

    def evaluate(batch, number):
        own = reports.alert_state(batch)
        before = spark.read.parquet(f"{base}/state/{number - 1}") if number else own.limit(0)
        # a batch that runs again starts from the same sums and writes the same folder
        reports.merged_states(before.union(own)).write.mode("overwrite").parquet(f"{base}/state/{number}")
        reports.alerts_of(spark.read.parquet(f"{base}/state/{number}")).write.mode("overwrite").parquet(f"{base}/alerts")

    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrivals")
    stream.writeStream.foreachBatch(evaluate).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/alerts").select("scope", "calls", "rule", "state")


@query("X09_production_transcript", "select conv_id::varchar as session_id, turn || '/' || role as turn_id, case when turn % 3 < 2 and text <> '' then text when turn % 4 = 2 then role else '' end as said, case when turn % 3 < 2 and text <> '' then 'stt_response' when turn % 4 = 2 then 'llm_history_inferred' else 'unavailable' end as source from conversations where text is not null")
def x09(spark, d):
    """Turns whose recogniser gave its text by itself or as its vendor nests it, and turns of
    which only one model request, two, or none hold the words."""
    said = table(spark, d, "conversations").filter("text is not null").withColumn("session_id", F.col("conv_id").cast("string")).withColumn("turn_id", F.concat_ws("/", F.col("turn").cast("string"), "role"))
    body = F.expr("case when turn % 3 = 0 then to_json(named_struct('transcript', text)) when turn % 3 = 1 then to_json(named_struct('results', named_struct('channels', array(named_struct('alternatives', array(named_struct('transcript', text))))))) else '{}' end")
    asked = said.withColumn("k", F.explode(F.expr("case when turn % 4 = 2 then array(0) when turn % 4 = 3 then array(0, 1) end")))
    return evaluation.production_transcripts(said.select("session_id", "turn_id", body.alias("body")), asked.select("session_id", "turn_id", F.col("role").alias("user_text")))


_FUNNEL = """with recursive """ + NESTED_SQL[5:] + """, sess as (select session_id, max(agent_id) as agent_id, any_value(started_ms - b) as created_ms, min(e) as m, case when min(e) % 9 = 0 then 'uploading' else 'ready' end as status, case when min(e) % 2 = 0 then '1.2' end as sdk_version, case when min(e) % 4 <> 1 and min(e) % 9 <> 0 then count(*) else 0 end as operations from bound group by 1)"""
_STATE = """state as (select agent_id, count(*) as sessions, arg_min(session_id, w) as first_session, arg_max(session_id, w) as latest_session, arg_min(session_id, w) filter (operations > 0) as captured_session, arg_min(session_id, w) filter (sdk_version is not null) as installed_session, arg_min(operations, w) filter (operations > 0) as captured_operations,
    min(sdk_version) as sdk_version, case when count(*) filter (operations > 0) = 0 then count(*) filter (status <> 'uploading') else 0 end as uploaded_without_operations, case when count(*) filter (operations > 0) = 0 then count(*) filter (status = 'uploading') else 0 end as in_flight from (select *, struct_pack(a := created_ms, b := session_id) as w from sess) s group by 1)"""


def _arrivals(spark, d):
    """Calls, of which some are still uploading or matched no endpoint, and their spans."""
    first = nested.turns_bound(spark, d).groupBy("session_id").agg(F.min("e").alias("m"), F.first(F.col("started_ms") - F.col("b")).alias("created_ms"), F.max("agent_id").alias("agent_id"))
    sessions = first.select("session_id", "agent_id", "created_ms", F.when(F.col("m") % 9 == 0, "uploading").otherwise("ready").alias("status"), F.when(F.col("m") % 2 == 0, "1.2").alias("sdk_version"))
    seen = first.filter("m % 4 <> 1 and m % 9 <> 0").select("session_id")
    return sessions, nested.spans_of(spark, d).filter("type = 'stt' and scope = 'turn'").join(seen, "session_id", "left_semi")


@query("A35_ingest_funnel", _FUNNEL + ", " + _STATE + " select * from state")
def a35(spark, d):
    return onboarding.ingest_state(*_arrivals(spark, d), ["agent_id"])


@query("A35_steps", _FUNNEL + ", " + _STATE + """ select agent_id, 1 as place, 'api-key' as step, 'verified' as state, null as waiting_for from state union all select agent_id, 2, 'install', case when installed_session is not null then 'verified' else 'waiting' end, case when installed_session is null then 'no_version_declared' end from state
    union all select agent_id, 3, 'instrument', 'verified', null from state union all select agent_id, 4, 'capture', case when captured_session is not null then 'verified' else 'waiting' end, case when captured_session is null then case when uploaded_without_operations > 0 then 'no_operations_recorded' else 'upload_never_finished' end end from state""")
def a35_steps(spark, d):
    return onboarding.steps(onboarding.ingest_state(*_arrivals(spark, d), ["agent_id"]), ["agent_id"], active_keys=1)


_SIDES = """sides as (select session_id, 0.0 as p_no_text, count(*) filter (e % 6 = 0) as c_no_text, count(*) filter (e % 7 = 0) as p_missing, count(*) filter (e % 4 = 1) as c_missing, quantile_cont(case when worded and final >= spoke_until then final - spoke_until end, 0.5) as p_final, quantile_cont(case when e % 4 <> 1 then v % 900 end, 0.5) as c_final,
    quantile_cont(300 - case when worded then 100 else 0 end, 0.5) as p_partial, quantile_cont(v % 700, 0.5) as c_partial, bool_or(worded)::integer as p_words, max(e) - min(e) as ms from heard group by 1)"""
_ROWS = {
    "no_text_turns": ("accuracy", "p_no_text", "c_no_text"), "missing_final_turns": ("accuracy", "p_missing", "c_missing"), "final_from_last_word_p50": ("latency", "p_final", "c_final"), "first_partial_p50": ("latency", "p_partial", "c_partial"),
    "streaming_partials": ("capability", "1", "1"), "word_timestamps": ("capability", "p_words", "1"), "confidence_scores": ("capability", "1", "0"), "vad_events": ("capability", "0", "1"),
    "per_minute": ("cost", "0.0048::double * 83", "0.0065::double * 83"), "per_call": ("cost", "0.0048::double * 83 * (ms / 60000)", "0.0065::double * 83 * (ms / 60000)"), "per_month": ("cost", "0.0048::double * 83 * 159600", "0.0065::double * 83 * 159600"),
}


@query("Q07_head_to_head", NESTED_SQL + ", " + _SIDES + ", long as (" + " union all ".join(f"select session_id, '{dim}' as dimension, '{m}' as metric, {'true' if dim != 'capability' else 'false'} as less, round({p}, 6)::double as production, case when session_id not like '%3' then round({c}, 6) end::double as challenger from sides" for m, (dim, p, c) in _ROWS.items()) + """)
    select session_id, dimension, metric, production, challenger, round(challenger - production, 6) as difference, case when production is null or challenger is null then 'unknown' when challenger = production then 'even' when (challenger < production) = less then 'challenger' else 'production' end as verdict from long""")
def q07(spark, d):
    """Recognition as captured against a challenger of the same turns; calls that end in 3 had none."""
    stt = stt_of(spark, d)
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), 6)
    own = stt.groupBy("session_id").agg(F.count_if(F.coalesce(F.trim("response.transcript"), F.lit("")) == "").alias("no_text_turns"), F.count_if("m.missing_final").alias("missing_final_turns"), median("m.final_from_last_word_ms").alias("final_from_last_word_p50"), median(F.col("m.first_partial_at_ms") - F.col("m.speech_start_ms")).alias("first_partial_p50"))
    e, v = F.col("e"), F.col("v")
    theirs = nested.turns_bound(spark, d).groupBy("session_id").agg(F.count_if(e % 6 == 0).alias("no_text_turns"), F.count_if(e % 4 == 1).alias("missing_final_turns"), median(F.when(e % 4 != 1, v % 900)).alias("final_from_last_word_p50"), median(v % 700).alias("first_partial_p50"))
    can = F.lit(True)
    theirs = theirs.withColumn("streaming_partials", can).withColumn("word_timestamps", can).withColumn("confidence_scores", ~can).withColumn("vad_events", can)
    minutes = nested.manifests(spark, d).select("session_id", (F.col("duration_ms") / 60000).alias("minutes"))
    price = lambda df, rate: df.join(minutes, "session_id").withColumn("per_minute", F.round(F.lit(rate * 83), 6)).withColumn("per_call", F.round(rate * 83 * F.col("minutes"), 6)).withColumn("per_month", F.round(F.lit(rate * 83 * 159600), 6))
    production = price(own.join(evaluation.production_capabilities(stt), "session_id"), 0.0048)
    return evaluation.head_to_head(production, price(theirs.filter("session_id not like '%3'"), 0.0065))
