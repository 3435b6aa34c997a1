"""Rollup tiers, dashboards, triage and alerts, over flat facts and over packages.

``FLAT`` and ``PACKAGE`` give in DuckDB the facts that both bindings have: tf (turns), cf
(calls), tl (tools, at their turn's start) and ff (failures, at their own).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import scalars
from callmetrics.operators import calls as packaged
from callmetrics.operators import facts, measures, rollups
from callmetrics.operators.facts import STAGES
from callmetrics.plans import reports
from callmetrics.plans.measure_queries import _BUCKETS, _IDX, summary_sql
from callmetrics.plans.package_queries import CALLS_CTE, FOLDED, TURN_COLUMNS
from callmetrics.plans.package_queries import calls_of as package_calls
from callmetrics.plans.package_queries import turns_of as package_turns
from callmetrics.plans.registry import FACTS, FAILED_SQL, query
from callmetrics.plans.scalar_queries import calls_of, turns_of
from callmetrics.sources import nested
from callmetrics.sources.binding import DAY_MS, operations

_START, _END = 1_705_000_000_000 // DAY_MS * DAY_MS, 1_706_500_000_000 // DAY_MS * DAY_MS
_FAILED = "(stt_failed + llm_failed + tts_failed + tool_failed)"
_NULLS = ", ".join(f"null::bigint as {m}" for m in rollups.METRICS[1:])
_NONE = ", ".join(f"false as {c}" for c in ("is_continuation", "has_continuation", "stt_missing_final", "stt_forced_flush", *(f"{s}_split" for s in STAGES)))

FLAT = FACTS + f""", tf as (select *, {_NULLS}, {_NONE} from turns), cf as (select *, 'unknown' as outcome, 'ready' as status, false as capture_incomplete, 0 as missing_final_turns, 0 as inferred_reply_turns from calls),
  tl as (select o.session_id, o.turn_id, o.tool_name, o.duration_ms, {FAILED_SQL.replace('status', 'o.status').replace('error_name', 'o.error_name')} as failed, o.status = 'error' and contains(lower(coalesce(o.error_name, '')), 'timeout') as timed_out, t.agent_id, t.started_ms from ops o join turns t using (session_id, turn_id) where o.stage = 'tool'),
  ff as (select session_id, turn_id, op_id, stage, agent_id, started_ms, stage || ':' || coalesce(error_name, 'UnknownError') as fingerprint from ops where {FAILED_SQL}) """
PACKAGE = FOLDED + f""", tf as (
    select {TURN_COLUMNS}, is_continuation, not is_continuation and count(*) over x > 1 as has_continuation, not is_continuation and count(*) over x > 1 as stt_split, not is_continuation and count(*) over x > 1 as llm_split,
      not is_continuation and count(*) filter (stage <> 'stt') over x > 1 as tts_split, not is_continuation and count(*) filter (stage = 'tool') over x > 1 as tool_split, null::varchar as tts_model from folded window x as (partition by root)
  ), {CALLS_CTE},
  tl as (select session_id, turn_id, coalesce(tool_name, 'tools') as tool_name, v as duration_ms, e % 8 = 0 as failed, e % 8 = 0 as timed_out, agent_id, started_ms from heard where stage = 'tool'),
  ff as (select session_id, turn_id, e || '-llm' as op_id, 'llm' as stage, agent_id, started_ms + 1200 as started_ms, 'llm:' || coalesce(error_name, 'UnknownError') as fingerprint from heard where llm_failed
    union all select session_id, turn_id, e || '-tool', 'tool', agent_id, started_ms + 1300, 'tool:TimeoutError' from heard where tool_failed) """

_sums = {
    "turns": "count(*) filter (not is_continuation)", "split_turns": "count(*) filter (has_continuation)", "measured": "count(response_ms)", "lag_turns": "count(*) filter (response_ms >= 3000)",
    **{f"{s}_{k}": f"coalesce(sum({s}_{k}), 0)::bigint" for k in ("ops", "failed") for s in STAGES}, "tts_interrupted": "coalesce(sum(tts_interrupted), 0)::bigint",
    "stt_missing_final": "count(*) filter (stt_missing_final)", "stt_forced_flush": "count(*) filter (stt_forced_flush)", **{f"{s}_turns": f"count(*) filter ({s}_ops > 0)" for s in STAGES},
    **{f"{s}_split_turns": f"count(*) filter ({s}_split)" for s in STAGES}, **{f"{s}_calls_impacted": f"count(distinct case when {s}_failed > 0 then session_id end)" for s in STAGES},
}
_call_sums = {
    "calls": "count(*)", "failing_calls": "count(*) filter (failed_ops > 0)", "capture_incomplete_calls": "count(*) filter (capture_incomplete)", "completed_calls": "count(*) filter (outcome = 'completed')",
    "incomplete_calls": "count(*) filter (status <> 'ready')", "total_duration_ms": "coalesce(sum(duration_ms), 0)::bigint",
}
_named = lambda sums: ", ".join(f"{v} as {k}" for k, v in sums.items())


def _scoped(table: str, where: str = "true") -> str:
    return f"(select * exclude (agent_id), unnest([coalesce(agent_id, ''), '__all__']) as agent_id, started_ms // 3600000 * 3600000 as bucket_ms from {table} where started_ms is not null and {where})"


_INTERVALS = f"""select bucket_ms, agent_id, {', '.join(f'coalesce({c}, 0) as {c}' for c in (*_sums, *_call_sums))} from (select bucket_ms, agent_id, {_named(_sums)} from {_scoped('tf')} t group by all) t
    full join (select bucket_ms, agent_id, {_named(_call_sums)} from {_scoped('cf')} c group by all) c using (bucket_ms, agent_id)"""


def _flat(spark, d):
    ops = operations(spark, d)
    turns = facts.turn_facts(ops)
    return turns, facts.call_facts(turns), facts.tool_facts(ops), facts.failure_facts(ops)


def _package(spark, d):
    ops, manifests = nested.measured_of(spark, d)[0], nested.manifests(spark, d)
    return package_turns(spark, d), package_calls(spark, d), packaged.tool_metrics(ops), packaged.failure_metrics(ops, manifests)


def _visible(df):
    return df.drop(*(c for c in df.columns if c.endswith("_hll")))


@query("A14_hourly_rollup", FLAT + _INTERVALS)
def a14(spark, d):
    turns, calls, *_ = _flat(spark, d)
    return _visible(rollups.interval_rollup(turns, calls))


@query("A14_package_rollup", PACKAGE + _INTERVALS)
def a14_package(spark, d):
    turns, calls, *_ = _package(spark, d)
    return _visible(rollups.interval_rollup(turns, calls))


_LONG = f"(select bucket_ms, agent_id, unnest({list(rollups.METRICS)}) as metric, unnest([{', '.join(f'{m}::double' for m in rollups.METRICS)}]) as v from {_scoped('tf')} t)"


@query("A15_metric_rollup", PACKAGE + f"select bucket_ms, agent_id, metric, {_IDX} as idx, {_BUCKETS} from {_LONG} l where v >= 0 group by 1, 2, 3, 4")
def a15(spark, d):
    return rollups.metric_rollup(package_turns(spark, d))


_TOOLS = f"select bucket_ms, agent_id, tool_name, count(*) as invocations, count(*) filter (failed) as failed, count(*) filter (timed_out) as timed_out, count(distinct session_id) as calls, count(distinct case when failed then session_id end) as failed_calls from {_scoped('tl')} t group by all"
_FAULTS = f"select bucket_ms, agent_id, stage, fingerprint, count(*) as n, count(distinct session_id) as calls from {_scoped('ff')} f group by all"


@query("A15_tool_rollup", PACKAGE + _TOOLS)
def a15_tools(spark, d):
    turns, _, tools, _ = _package(spark, d)
    return _visible(rollups.tool_rollup(rollups.in_turns(tools, turns)))


@query("A15_tool_sketches", PACKAGE + f"select bucket_ms, agent_id, tool_name, {_IDX} as idx, {_BUCKETS} from (select *, duration_ms as v from {_scoped('tl')} s) t where v >= 0 group by 1, 2, 3, 4")
def a15_sketches(spark, d):
    turns, _, tools, _ = _package(spark, d)
    return rollups.tool_sketches(rollups.in_turns(tools, turns))


@query("A15_failure_rollup", PACKAGE + _FAULTS)
def a15_failures(spark, d):
    return _visible(rollups.failure_rollup(_package(spark, d)[3]))


@query("A15_flat_tool_rollup", FLAT + _TOOLS)
def a15_flat_tools(spark, d):
    turns, _, tools, _ = _flat(spark, d)
    return _visible(rollups.tool_rollup(rollups.in_turns(tools, turns)))


@query("A15_flat_failure_rollup", FLAT + _FAULTS)
def a15_flat_failures(spark, d):
    return _visible(rollups.failure_rollup(_flat(spark, d)[3]))


def _in_range(column: str = "started_ms") -> str:
    return f"{column} >= {_START} and {column} < {_END}"


@query("A16_range_totals", PACKAGE + f"select agent_id, {', '.join(f'sum({c})::bigint as {c}' for c in (*_sums, *_call_sums) if not c.endswith('_impacted'))} from ({_INTERVALS}) r where {_in_range('bucket_ms')} group by agent_id")
def a16(spark, d):
    """Counters of a range, from its hours alone."""
    turns, calls, *_ = _package(spark, d)
    hours = rollups.interval_rollup(turns, calls)
    within = hours.filter((F.col("bucket_ms") >= _START) & (F.col("bucket_ms") < _END))
    return rollups.range_counters(within, "agent_id").drop(*rollups.IMPACTED)


_DISTINCT = " union all ".join(f"select agent_id, '{s}' as stage, count(distinct case when {s}_failed > 0 then session_id end) as calls, true as estimate_within_2_percent from {_scoped('tf', _in_range())} t group by agent_id" for s in STAGES)


@query("A16_distinct_calls", PACKAGE + _DISTINCT)
def a16_distinct(spark, d):
    """Calls that a stage's failures touched: counted over the range, and whether the union
    of the hours' sketches comes within 2 % of that."""
    turns, calls, *_ = _package(spark, d)
    turns = turns.filter((F.col("started_ms") >= _START) & (F.col("started_ms") < _END))
    guess = rollups.range_counters(rollups.interval_rollup(turns, calls.limit(0)), "agent_id")
    each = facts.complete_turns(turns).groupBy("agent_id", "session_id").agg(*(F.sum(f"{s}_failed").alias(s) for s in STAGES))
    exact = rollups.in_scopes(each, [], *(F.count_if(F.col(s) > 0).alias(s) for s in STAGES))
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("calls"), (F.abs(F.col(f"{s}_calls_impacted") - F.col(s)) <= 0.02 * F.col(s)).alias("estimate_within_2_percent")) for s in STAGES))
    return exact.join(guess, "agent_id").select("agent_id", F.inline(rows))


_RANGE_TOOLS = f"select tool_name, count(*) as invocations, count(*) filter (failed) as failed, count(*) filter (timed_out) as timed_out, count(distinct session_id) as calls, count(distinct case when failed then session_id end) as failed_calls from tl where {_in_range()} group by 1"


@query("A16_range_tools", PACKAGE + f"select t.tool_name, invocations, failed, timed_out, s.n as measured, s.p50, s.p95, s.p95_confident from ({_RANGE_TOOLS}) t join ({summary_sql(f'select tool_name, duration_ms as v from tl where {_in_range()}', 'tool_name')}) s using (tool_name)")
def a16_tools(spark, d):
    own = rollups.build(*_package(spark, d)).between(_START, _END)
    return rollups.range_tools(own).drop("calls", "failed_calls")


@query("A16_range_failures", PACKAGE + f"select fingerprint, stage, count(*) as n from ff where {_in_range()} group by all")
def a16_failures(spark, d):
    return rollups.range_failures(rollups.failure_rollup(_package(spark, d)[3]).filter((F.col("bucket_ms") >= _START) & (F.col("bucket_ms") < _END) & (F.col("agent_id") == measures.ALL_AGENTS))).drop("calls")


_TREND = f"""select b.bucket_ms, coalesce(turns, 0) as turns, coalesce(failed_ops, 0) as failed_ops, coalesce(measured, 0) as measured, coalesce(lag_turns, 0) as lag_turns, p50, p95, coalesce(calls, 0) as calls from (select unnest(range({_START}, {_END}, {DAY_MS})) as bucket_ms) b
    left join (select started_ms // {DAY_MS} * {DAY_MS} as bucket_ms, count(*) filter (not is_continuation) as turns, sum({_FAILED})::bigint as failed_ops, count(response_ms) as measured, count(*) filter (response_ms >= 3000) as lag_turns, quantile_disc(response_ms, 0.5)::double as p50, quantile_disc(response_ms, 0.95)::double as p95 from tf group by 1) t on t.bucket_ms = b.bucket_ms
    left join (select started_ms // {DAY_MS} * {DAY_MS} as bucket_ms, count(*) as calls from cf group by 1) c on c.bucket_ms = b.bucket_ms"""


@query("A17_trend", FLAT + _TREND)
def a17(spark, d):
    turns, calls, *_ = _flat(spark, d)
    return measures.trend(turns, calls, _START, _END, DAY_MS)


@query("A17_package_trend", PACKAGE + _TREND)
def a17_package(spark, d):
    turns, calls, *_ = _package(spark, d)
    return measures.trend(turns, calls, _START, _END, DAY_MS)


_OVERVIEW = f"""select *, round(failing_calls / nullif(calls, 0), 6) as failure_rate, round(inferred_reply_turns / nullif(turns, 0), 6) as inferred_share, round(lag_turns / nullif(measured, 0), 6) as lag_rate from (
    select {_named(_call_sums)}, {', '.join(f'coalesce(sum({c}), 0)::bigint as {c}' for c in ('turns', 'inferred_reply_turns', 'measured', 'lag_turns'))} from cf) o"""


@query("A18_overview", FLAT + _OVERVIEW)
def a18(spark, d):
    return reports.overview(calls_of(spark, d))


@query("A18_package_overview", PACKAGE + _OVERVIEW)
def a18_package(spark, d):
    return reports.overview(package_calls(spark, d))


def _change(now: str, before: str, n: str = "n_now", m: str = "n_before") -> dict[str, str]:
    """Columns of measures.change() over two values and their counts."""
    reason = f"case when coalesce({n}, 0) = 0 or coalesce({m}, 0) = 0 then 'no_previous_period' when {n} < 30 or {m} < 30 then 'below_minimum_sample' when coalesce({before}, 0) = 0 then 'no_previous_period' end"
    ok = f"({reason}) is null"
    return {
        "available": ok, "reason": reason, "previous": f"case when {ok} then {before} end", "current": f"case when {ok} then {now} end", "absolute": f"case when {ok} then {now} - {before} end", "relative": f"case when {ok} then round(({now} - {before}) / {before}, 6) end"
    }


_P95 = _change("p95_now", "p95_before")
_PERIODS = f"""select agent_id, n_now, n_before, {_named(_change('p50_now', 'p50_before'))}, {_P95['absolute']} as absolute_p95, {_P95['relative']} as relative_p95 from (
    select agent_id, count(response_ms) filter (started_ms >= {_START}) as n_now, count(response_ms) filter (started_ms < {_START}) as n_before, quantile_disc(response_ms, 0.5) filter (started_ms >= {_START})::double as p50_now, quantile_disc(response_ms, 0.5) filter (started_ms < {_START})::double as p50_before,
    quantile_disc(response_ms, 0.95) filter (started_ms >= {_START})::double as p95_now, quantile_disc(response_ms, 0.95) filter (started_ms < {_START})::double as p95_before from tf where started_ms >= {2 * _START - _END} and started_ms < {_END} group by agent_id) p"""


@query("A19_period_delta", FLAT + _PERIODS)
def a19(spark, d):
    return measures.period_delta(turns_of(spark, d), _START, _END)


@query("A19_package_delta", PACKAGE + _PERIODS)
def a19_package(spark, d):
    return measures.period_delta(package_turns(spark, d), _START, _END)


def _stages(turns: str, calls: str) -> str:
    one = lambda s: f"select '{s}' as stage, {s}_ops as ops, {s}_failed as failed, round({s}_failed / nullif({s}_ops, 0), 6) as failure_rate, {s}_turns as turns, {s}_split_turns as split_turns, least({s}_calls_impacted, k.calls) as calls_impacted, round(least({s}_calls_impacted, k.calls) / nullif(k.calls, 0), 6) as impacted_rate from sums, k"
    return f"with sums as (select {_named(_sums)} from {turns}), k as (select count(*) as calls from {calls}) " + " union all ".join(map(one, STAGES))


@query("A12_stage_counters", FLAT + f"select * from ({_stages('tf', 'cf')}) s")
def a12(spark, d):
    turns, calls, *_ = _flat(spark, d)
    return reports.stage_counters(reports.turn_counters(turns), reports.overview(calls))


@query("A12_package_stages", PACKAGE + f"select * from ({_stages('tf', 'cf')}) s")
def a12_package(spark, d):
    turns, calls, *_ = _package(spark, d)
    return reports.stage_counters(reports.turn_counters(turns), reports.overview(calls))


@query("A20_stage_extras", PACKAGE + f"select stage, key, n as count, eligible, round(n / nullif(eligible, 0), 6) as rate from (select {_named(_sums)} from tf) s, lateral (values {', '.join(f'''('{s}', '{k}', {k}, {o})''' for s, k, o in reports.EXTRAS)}) x(stage, key, n, eligible)")
def a20_extras(spark, d):
    return reports.stage_extras(reports.turn_counters(package_turns(spark, d)))


_PANEL_NAMES = ", ".join(f"('{s}', '{m}')" for s, own in reports.PANELS.items() for m in own)
_METRIC_ROWS = f"select started_ms, unnest({list(rollups.METRICS)}) as metric, unnest([{', '.join(f'{m}::double' for m in rollups.METRICS)}]) as v from tf"
_STATS = "count(v) as n, " + ", ".join(f"quantile_disc(v, {p / 100})::double as p{p}" for p in (50, 90, 95, 99)) + ", min(v)::double as least, max(v)::double as greatest, round(avg(v), 6) as mean"
_PANELS = f"""select p.stage, p.metric, coalesce(n, 0) as n, p50, p90, p95, p99, least, greatest, mean, coalesce(n, 0) >= 5 as p50_confident, coalesce(n, 0) >= 20 as p95_confident, coalesce(n, 0) >= 100 as p95_stable,
    case when coalesce(n, 0) = 0 then case when ops = 0 then 'stage_absent' else 'milestone_not_captured' end end as reason, s.turns as eligible, round(coalesce(n, 0) / nullif(s.turns, 0), 6) as coverage, s.split_turns, {', '.join(f'{v} as change_{k}' for k, v in _change('p50', 'old', 'n', 'm').items() if k in ('available', 'reason', 'absolute', 'relative'))}
    from (values {_PANEL_NAMES}) p(stage, metric) left join (select metric, {_STATS} from ({_METRIC_ROWS}) r where v >= 0 and {_in_range()} group by metric) a using (metric)
    left join (select metric, count(v) as m, quantile_disc(v, 0.5) as old from ({_METRIC_ROWS}) r where v >= 0 and started_ms >= {2 * _START - _END} and started_ms < {_START} group by metric) b using (metric)
    join ({_stages(f'(select * from tf where {_in_range()})', f'(select * from cf where {_in_range()})')}) s using (stage)"""


def _panels(turns, calls):
    range_ = reports.Filters(_START, _END)
    panels = reports.summary(turns, range_, calls, limit=1 << 40)["panels"]
    return panels.select("*", *(F.col(f"change.{c}").alias(f"change_{c}") for c in ("available", "reason", "absolute", "relative"))).drop("change")


@query("A20_stage_panels", FLAT + _PANELS)
def a20(spark, d):
    """Flat facts measure no stage: every panel says so."""
    turns, calls, *_ = _flat(spark, d)
    return _panels(turns, calls)


@query("A20_package_panels", PACKAGE + _PANELS)
def a20_package(spark, d):
    turns, calls, *_ = _package(spark, d)
    return _panels(turns, calls)


@query("F01_call_filter", PACKAGE + f"select session_id from cf where {_in_range()} and environment = 'production' and agent_version = '7' and sdk_language is null union all select session_id from cf where {_in_range()} and agent_id = 'agent-3' and sdk_language = 'python'")
def f01(spark, d):
    turns, calls, *_ = _package(spark, d)
    released = reports.Filters(_START, _END, environment="production", agent_version="7").calls(calls, turns).filter("sdk_language is null")
    return released.select("session_id").union(reports.Filters(_START, _END, agent_id="agent-3", sdk_language="python").calls(calls, turns).select("session_id"))


@query("F03_provider_filter", PACKAGE + f"select session_id from cf where {_in_range()} and session_id in (select session_id from tf where 'deepgram' in (stt_provider, llm_provider, tts_provider)) and session_id in (select session_id from tf where 'nova-2' in (stt_model, llm_model, tts_model))")
def f03(spark, d):
    turns, calls, *_ = _package(spark, d)
    return reports.Filters(_START, _END, provider="deepgram", model="nova-2").calls(calls, turns).select("session_id")


@query("F03_filtered_turns", PACKAGE + f"select session_id, turn_id from tf where {_in_range()} and session_id in (select session_id from cf where environment = 'staging') and session_id in (select session_id from tf where 'azure-openai' in (stt_provider, llm_provider, tts_provider))")
def f03_turns(spark, d):
    turns, calls, *_ = _package(spark, d)
    return reports.Filters(_START, _END, provider="azure-openai", environment="staging").turns(turns, calls).select("session_id", "turn_id")


@query("F04_selectors", PACKAGE + " union all ".join(f"select '{k}' as selector, count(*) as n from cf where {v}" for k, v in reports.SELECTORS.items()))
def f04(spark, d):
    counts = package_calls(spark, d).agg(*(F.count_if(F.expr(v)).alias(k) for k, v in reports.SELECTORS.items()))
    return counts.unpivot([], list(reports.SELECTORS), "selector", "n")


@query("F06_attention_predicate", PACKAGE + f"select session_id from cf where {scalars.ATTENTION}")
def f06(spark, d):
    return package_calls(spark, d).filter(scalars.ATTENTION).select("session_id")


_SEVERITY = f"case when failed_ops > 0 then 3 when capture_incomplete or missing_final_turns > 0 or {scalars.UNMEASURED} then 2 when lag_turns > 0 then 1 else 0 end"
_REASONS = "array_to_string(list_filter([" + ", ".join(
    [f"case when {s}_failed > 0 then 'failure/{s}/' || {s}_failed || '/' || {s}_failed || ' {s.upper()} failure' || case when {s}_failed > 1 then 's' else '' end end" for s in STAGES]
    + [
        "case when lag_turns > 0 then 'slow/overall/' || lag_turns || '/' || lag_turns || ' turn' || case when lag_turns > 1 then 's' else '' end || ' over 3s' end",
        "case when missing_final_turns > 0 then 'missing_final/stt/' || missing_final_turns || '/' || missing_final_turns || ' turn' || case when missing_final_turns > 1 then 's' else '' end || ' with no final transcript' end",
        "case when turns > 0 and measured = 0 then 'unmeasured/overall/' || turns || '/No response latency could be measured' end",
        "case when capture_incomplete then 'capture/capture/1/Capture incomplete - evidence may be missing' end",
    ]
) + "], lambda x: x is not null), ';')"


def _reasons(column="reasons"):
    return F.array_join(F.transform(column, lambda x: F.concat_ws("/", x["kind"], x["stage"], x["count"].cast("string"), x["label"])), ";")


@query("P22_severity", PACKAGE + f"select session_id, {_SEVERITY} as severity from cf")
def p22(spark, d):
    return package_calls(spark, d).select("session_id", scalars.severity().alias("severity"))


@query("P23_attention_reasons", PACKAGE + f"select session_id, {_REASONS} as reasons from cf")
def p23(spark, d):
    return package_calls(spark, d).withColumn("reasons", scalars.attention_reasons()).select("session_id", _reasons().alias("reasons"))


_FOCUS = """coalesce((select arg_min(turn_id, struct_pack(a := f.started_ms, b := f.op_id)) from ff f where f.session_id = c.session_id), (select arg_min(turn_id, struct_pack(a := -t.response_ms, b := t.started_ms, c := t.turn_id)) from tf t where t.session_id = c.session_id and t.response_ms is not null)) as focus_turn_id,
    (select string_agg(distinct fingerprint, ',' order by fingerprint) from ff f where f.session_id = c.session_id) as fingerprints"""
_ATTENTION = f"""select session_id, severity, total, reasons, {_FOCUS} from (select *, {_SEVERITY} as severity, {_REASONS} as reasons, count(*) over () as total from cf where {scalars.ATTENTION}
    order by severity desc, failed_ops desc, coalesce(max_response_ms, 0) desc, started_ms desc, session_id limit 25) c"""


@query("T01_attention", PACKAGE + _ATTENTION)
def t01(spark, d):
    turns, calls, _, failures = _package(spark, d)
    return reports.attention(calls, turns, failures).select("session_id", "severity", "total", _reasons().alias("reasons"), "focus_turn_id", F.array_join("fingerprints", ",").alias("fingerprints"))


def _page(selector: str, order: str, extra: str = "true") -> str:
    return f"select session_id, max_response_ms, failed_ops, total, focus_turn_id from (select session_id, max_response_ms, failed_ops, total, {_FOCUS} from (select *, count(*) over () as total from cf where {_in_range()} and {reports.SELECTORS[selector]} and {extra} order by {order}, session_id limit 20 offset 10) c) p"


@query("T02_drilldown_page", PACKAGE + _page("slowest", "coalesce(max_response_ms, 0) desc"))
def t02(spark, d):
    turns, calls, _, failures = _package(spark, d)
    page = reports.drilldown(calls, turns, reports.Filters(_START, _END), "slowest", failures=failures, limit=20, offset=10)
    return page.select("session_id", "max_response_ms", "failed_ops", "total", "focus_turn_id")


_BY_TOOL = "session_id in (select session_id from tl where tool_name = 'tool_3') and session_id in (select session_id from ff where fingerprint = 'tool:TimeoutError')"


@query("T02_drilldown_tool", PACKAGE + _page("llm_failures", "failed_ops desc, started_ms desc", _BY_TOOL).replace("offset 10", "offset 0"))
def t02_tool(spark, d):
    turns, calls, tools, failures = _package(spark, d)
    page = reports.drilldown(calls, turns, reports.Filters(_START, _END), "llm_failures", tools, failures, tool_name="tool_3", fingerprint="tool:TimeoutError", limit=20)
    return page.select("session_id", "max_response_ms", "failed_ops", "total", "focus_turn_id")


ALERT_SQL = """, scoped as (select *, unnest(['fleet', agent_id]) as scope from tf), each as (select scope, count(distinct session_id) as calls, count(*) filter (not is_continuation) as turns, count(response_ms) as measured, count(*) filter (response_ms >= 3000) as lag, count(distinct case when {f} > 0 then session_id end) as failing, quantile_disc(response_ms, 0.95)::double as p95 from scoped group by scope),
    long as (select scope, calls, 'audible-lag' as rule, case when measured >= 10 then round(lag / measured, 6) end as observed, 0.25 as threshold, 'critical' as sev from each union all select scope, calls, 'failed-calls', round(failing / calls, 6), 0.05, 'critical' from each
    union all select scope, calls, 'worst-case-wait', case when measured >= 20 then p95 end, 8000, 'warning' from each union all select scope, calls, 'blind-turns', case when turns >= 20 then round((turns - measured) / turns, 6) end, 0.40, 'warning' from each),
    stated as (select *, case when observed is null or calls < 3 then 'unknown' when observed > threshold then 'firing' else 'ok' end as state from long) """.format(f=_FAILED)
_ALERTS = "select scope, calls, rule, observed::double as observed, threshold::double as threshold, state, case when state = 'firing' then sev else 'none' end as severity, case when state = 'firing' then round((observed::double - threshold::double) / threshold::double, 6) end as excess from stated"
_SHOWN = " union all ".join(
    f"select scope, '{rule}' as rule, session_id, slow, failed, started_ms from own where {when}"
    for rule, when in {"audible-lag": "lag > 0", "failed-calls": "failed > 0", "worst-case-wait": "slow is not null", "blind-turns": "measured < turns"}.items()
)
_EVIDENCE = f""", own as (select scope, session_id, min(started_ms) as started_ms, max(response_ms) as slow, sum({_FAILED}) as failed, count(*) filter (response_ms >= 3000) as lag, count(response_ms) as measured, count(*) filter (not is_continuation) as turns from scoped group by all),
    best as (select scope, rule, string_agg(session_id, ',' order by n) as evidence from (select *, row_number() over (partition by scope, rule order by coalesce(slow, -1) desc, failed desc, started_ms desc, session_id) as n from ({_SHOWN}) s) r where n <= 3 group by all)
    select a.* exclude (bare) replace (case when bare then 'unknown' else state end as state, case when bare then 'none' else severity end as severity, case when not bare then excess end as excess) from (
      select a.*, case when a.state = 'firing' then b.evidence end as evidence, a.state = 'firing' and b.evidence is null as bare from ({_ALERTS}) a left join best b using (scope, rule)) a"""


@query("Q03_alerts", FLAT + ALERT_SQL + _ALERTS)
def q03(spark, d):
    return reports.alerts(turns_of(spark, d))


@query("Q03_alert_evidence", PACKAGE + ALERT_SQL + _EVIDENCE)
def q03_evidence(spark, d):
    turns = package_turns(spark, d)
    return reports.alert_evidence(reports.alerts(turns), turns).withColumn("evidence", F.array_join("evidence", ","))


def _figures(parts: dict) -> "F.DataFrame":  # noqa: UP037
    """One row a figure of a dashboard: part, key, name, value."""
    wanted = {
        "overview": ([], ["calls", "turns", "completed_calls", "incomplete_calls", "failing_calls", "total_duration_ms", "inferred_reply_turns"]), "latency": ([], ["n", "p50", "p95", "mean"]), "panels": (["metric"], ["n", "p50", "p95", "eligible", "coverage", "split_turns"]),
        "stages": (["stage"], ["ops", "failed", "failure_rate", "turns"]), "extras": (["key"], ["count", "rate"]), "trend": (["bucket_ms"], ["calls", "turns", "failed_ops", "measured", "lag_turns", "p50", "p95"]),
        "tools": (["tool_name"], ["invocations", "failed", "timed_out", "measured", "p95"]), "failures": (["fingerprint"], ["n"]),
    }
    out = None
    for part, (keys, names) in wanted.items():
        key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key")
        rows = parts[part].select(key, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["key"], names, "name", "value").select(F.lit(part).alias("part"), "key", "name", "value")
        out = rows if out is None else out.union(rows)
    return out


def _figures_sql(stats: str, trend: str, tools: str) -> str:
    """The same rows in SQL, given how percentiles are made."""
    long = lambda part, key, names, source: " union all ".join(f"select '{part}' as part, {key} as key, '{n}' as name, {n}::double as value from ({source}) x" for n in names)
    turns, calls = f"(select * from tf where {_in_range()})", f"(select * from cf where {_in_range()})"
    panels = f"select p.metric, coalesce(n, 0) as n, p50, p95, s.turns as eligible, round(coalesce(n, 0) / nullif(s.turns, 0), 6) as coverage, s.split_turns from (values {_PANEL_NAMES}) p(stage, metric) left join ({stats}) a using (metric) join ({_stages(turns, calls)}) s using (stage)"
    extras = f"select key, n as count, round(n / nullif(eligible, 0), 6) as rate from (select {_named(_sums)} from {turns}) s, lateral (values {', '.join(f'''('{k}', {k}, {o})''' for _, k, o in reports.EXTRAS)}) x(key, n, eligible)"
    parts = [
        long("overview", "''", ["calls", "turns", "completed_calls", "incomplete_calls", "failing_calls", "total_duration_ms", "inferred_reply_turns"], _OVERVIEW.replace("from cf)", f"from cf where {_in_range()})")), long("latency", "''", ["n", "p50", "p95", "mean"], f"select * from ({stats}) a where metric = 'response_ms'"),
        long("panels", "metric", ["n", "p50", "p95", "eligible", "coverage", "split_turns"], panels), long("stages", "stage", ["ops", "failed", "failure_rate", "turns"], _stages(turns, calls)), long("extras", "key", ["count", "rate"], extras),
        long("trend", "bucket_ms::varchar", ["calls", "turns", "failed_ops", "measured", "lag_turns", "p50", "p95"], trend), long("tools", "tool_name", ["invocations", "failed", "timed_out", "measured", "p95"], tools),
        long("failures", "fingerprint", ["n"], f"select fingerprint, stage, count(*) as n from ff where {_in_range()} group by all order by n desc, fingerprint, stage limit 12"),
    ]
    return " union all ".join(f"({p})" for p in parts)


_EXACT_TOOLS = f"select t.*, m.measured, m.p95 from ({_RANGE_TOOLS}) t join (select tool_name, count(duration_ms) as measured, quantile_disc(duration_ms, 0.95)::double as p95 from tl where {_in_range()} group by 1) m using (tool_name)"
_SKETCH_TREND = _TREND.replace(", p50, p95,", ", q.p50, q.p95,") + f" left join ({summary_sql(f'select started_ms // {DAY_MS} * {DAY_MS} as bucket_ms, response_ms as v from tf where response_ms is not null', 'bucket_ms')}) q on q.bucket_ms = b.bucket_ms"


@query("Q01_summary", PACKAGE + _figures_sql(f"select metric, {_STATS} from ({_METRIC_ROWS}) r where v >= 0 and {_in_range()} group by metric", _TREND, _EXACT_TOOLS))
def q01(spark, d):
    """Every figure of a dashboard, from turns."""
    turns, calls, tools, failures = _package(spark, d)
    return _figures(reports.summary(turns, reports.Filters(_START, _END), calls, tools, failures, limit=1 << 40))


@query("Q01_rollup_summary", PACKAGE + _figures_sql(summary_sql(f"select metric, v from ({_METRIC_ROWS}) r where v is not null and {_in_range()}", "metric"), _SKETCH_TREND, f"select t.*, s.n as measured, s.p95 from ({_RANGE_TOOLS}) t join ({summary_sql(f'select tool_name, duration_ms as v from tl where {_in_range()}', 'tool_name')}) s using (tool_name)"))
def q01_rollup(spark, d):
    """The same figures of the same range, from hourly tiers alone."""
    turns, calls, tools, failures = _package(spark, d)
    tiers = rollups.build(turns, calls, tools, failures)
    return _figures(reports.summary(turns, reports.Filters(_START, _END), calls, tools, failures, tiers, limit=0))


@query("F09_range_guard", PACKAGE + f"select way, count(*) filter (not is_continuation) as exchanges, case way when 'refused' then 'range_too_large_for_filter' end as reason from tf, (values ('exact'), ('rollup'), ('refused')) w(way) where {_in_range()} group by way")
def f09(spark, d):
    """The same range answered from turns, from tiers, and refused for a filter that all calls pass."""
    turns, calls, tools, failures = _package(spark, d)
    tiers = rollups.build(turns, calls, tools, failures)
    every = {"exact": (reports.Filters(_START, _END), 1 << 40), "rollup": (reports.Filters(_START, _END), 0), "refused": (reports.Filters(_START, _END, model="gpt"), 0)}
    said = [reports.summary(turns, filters, calls, tiers=tiers, limit=limit)["accuracy"].select("way", "exchanges", "reason") for filters, limit in every.values()]
    return said[0].union(said[1]).union(said[2])
