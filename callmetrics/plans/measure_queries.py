"""Aggregates, windows, orders, sets, text scores and reports over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callmetrics.functions import text
from callmetrics.operators import challenger, cost, facts, intervals, measures
from callmetrics.plans import reports
from callmetrics.plans.registry import FACTS, FAILED_SQL, OPS, query
from callmetrics.plans.scalar_queries import calls_of, turns_of
from callmetrics.sources.binding import operations, table

_DIST = "count(v) as n, quantile_disc(v, 0.5)::double as p50, quantile_disc(v, 0.9)::double as p90, quantile_disc(v, 0.95)::double as p95, quantile_disc(v, 0.99)::double as p99, min(v) as least, max(v) as greatest, round(avg(v), 6) as mean, count(v) >= 5 as p50_confident, count(v) >= 20 as p95_confident, count(v) >= 100 as p95_stable"
_FAILED = "stt_failed + llm_failed + tts_failed + tool_failed"


@query("fleet_hourly", FACTS + f"select agent_id, started_ms // 3600000 * 3600000 as hour_ms, count(*) as turns, count(distinct session_id) as calls, sum({_FAILED})::bigint as failed_ops, count(response_ms) as measured, count(*) filter (response_ms >= 3000) as lag_turns, quantile_disc(response_ms, 0.5)::double as p50, quantile_disc(response_ms, 0.95)::double as p95 from turns group by 1, 2")
def fleet_hourly(spark, d):
    """The flagship: per agent and hour, turns, calls, failures and latency."""
    turns = turns_of(spark, d).withColumn("hour_ms", F.expr("started_ms div 3600000 * 3600000"))
    keys = ["agent_id", "hour_ms"]
    each = turns.groupBy(*keys, "session_id").agg(F.count("*").alias("turns"), F.sum(F.expr(measures.FAILED)).alias("failed_ops"), F.count("response_ms").alias("measured"), F.count_if(F.col("response_ms") >= 3000).alias("lag_turns"))
    sums = each.groupBy(*keys).agg(F.sum("turns").alias("turns"), F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("failed_ops", "measured", "lag_turns")))
    ranks = measures.nearest_ranks(measures.value_counts(turns, keys, "response_ms"), keys, {"p50": 0.5, "p95": 0.95})
    return sums.join(ranks.select(*keys, "p50", "p95"), keys)


@query("A01_percentile", OPS + "select stage, quantile_disc(duration_ms, 0.5)::double as p50, quantile_disc(duration_ms, 0.95)::double as p95 from ops group by stage")
def a01(spark, d):
    counts = measures.value_counts(operations(spark, d), ["stage"], "duration_ms")
    return measures.nearest_ranks(counts, ["stage"], {"p50": 0.5, "p95": 0.95}).select("stage", "p50", "p95")


@query("A02_distribution", FACTS + f"select agent_id, {_DIST} from (select agent_id, case when response_ms >= 0 then response_ms end as v from turns) t group by agent_id")
def a02(spark, d):
    return measures.distribution(turns_of(spark, d), ["agent_id"], "response_ms")


@query("A03_linear_percentiles", FACTS + "select session_id, count(response_ms) as n, round(quantile_cont(response_ms, 0.5), 6) as p50, round(quantile_cont(response_ms, 0.9), 6) as p90, round(quantile_cont(response_ms, 0.95), 6) as p95, min(response_ms) as least, max(response_ms) as greatest, round(avg(response_ms), 6) as mean from turns group by session_id")
def a03(spark, d):
    return measures.linear_percentiles(turns_of(spark, d), ["session_id"], "response_ms")


_IDX = f"case when v < 0 then null when v < 1 then -1 else ceil(ln(v::double) / {measures.LN_GAMMA})::bigint end"


_BUCKETS = "count(*) as weight, sum(v)::double as total, min(v)::double as least, max(v)::double as greatest"


@query("A04_sketch_build", OPS + f"select stage, {_IDX} as idx, {_BUCKETS} from (select stage, duration_ms as v from ops) o where v >= 0 group by 1, 2")
def a04(spark, d):
    return measures.sketch_build(operations(spark, d), ["stage"], "duration_ms")


@query("A05_sketch_merge", OPS + f"select stage, {_IDX} as idx, {_BUCKETS} from (select stage, duration_ms as v from ops) o where v >= 0 group by 1, 2")
def a05(spark, d):
    return measures.sketch_merge(measures.sketch_build(operations(spark, d), ["agent_id", "stage"], "duration_ms"), ["stage"])


#: The value of a bucket, between the least and greatest values seen.
_MIDDLE = f"greatest(least, least(greatest, case when idx = -1 then 0.0 else 2 * exp(idx * {measures.LN_GAMMA}) / (exp({measures.LN_GAMMA}) + 1) end))"


def summary_sql(source: str, keys: str) -> str:
    """The summary of sketches over rows (keys, v), in DuckDB."""
    at = lambda p: f"min(case when upto >= ceil(round(n * {p}, 9)) then idx end)"
    value = lambda p: "round_even(" + _MIDDLE.replace("greatest(least, least(greatest,", "greatest(lo, least(hi,").replace("idx", f"i{p}") + ", 0)::double"
    buckets = f"select {keys}, {_IDX} as idx, count(*) as w, sum(v)::double as total, min(v)::double as lo, max(v)::double as hi from ({source}) s where v >= 0 group by all"
    upto = f"select *, sum(w) over (partition by {keys} order by idx) as upto, sum(w) over (partition by {keys}) as n from ({buckets}) b"
    found = f"select {keys}, max(n)::bigint as n, {', '.join(f'{at(p / 100)} as i{p}' for p in (50, 90, 95, 99))}, min(lo) as lo, max(hi) as hi, sum(total) as total from ({upto}) u group by {keys}"
    shown = ", ".join(f"{value(p)} as p{p}" for p in (50, 90, 95, 99))
    return f"select {keys}, n, {shown}, round_even(lo, 0)::double as least, round_even(hi, 0)::double as greatest, round_even(total / n, 0)::double as mean, n >= 5 as p50_confident, n >= 20 as p95_confident, n >= 100 as p95_stable from ({found}) f"


@query("A06_sketch_quantile", OPS + summary_sql("select stage, duration_ms as v from ops", "stage"))
def a06(spark, d):
    """Every statistic of a sketch, in the shape of the exact distribution."""
    return measures.sketch_summary(measures.sketch_build(operations(spark, d), ["agent_id", "stage"], "duration_ms"), ["stage"])


@query("A07_reply_latency", OPS + "select session_id, turn_id, case when h - e >= 250 then h - e end as reply_ms, first_op from (select session_id, turn_id, min(case when stage = 'tts' then started_ms end) as h, min(case when stage = 'stt' then ended_ms end) as e, (list(op_id order by started_ms, op_id))[1] as first_op from ops group by 1, 2) t")
def a07(spark, d):
    return facts.op_reply_latency(operations(spark, d))


@query("A08_turn_metrics", FACTS + "select * from turns")
def a08(spark, d):
    return turns_of(spark, d)


@query("A09_call_metrics", FACTS + "select * from calls")
def a09(spark, d):
    return calls_of(spark, d)


@query("A10_tool_summary", OPS + f"select tool_name, count(*) as invocations, count(distinct session_id) as calls, count(*) filter (f) as failed, count(distinct case when f then session_id end) as failed_calls, count(*) filter (f and contains(lower(error_name), 'timeout')) as timed_out, count(duration_ms) as measured, quantile_disc(duration_ms, 0.5)::double as p50, quantile_disc(duration_ms, 0.95)::double as p95, count(duration_ms) >= 20 as p95_confident, count(*) >= 5 as rankable from (select * replace (case when duration_ms >= 0 then duration_ms end as duration_ms), {FAILED_SQL} as f from ops where stage = 'tool') t group by tool_name")
def a10(spark, d):
    return measures.tool_summary(facts.tool_facts(operations(spark, d)))


@query("A11_failure_summary", OPS + f"select stage || ':' || coalesce(error_name, 'UnknownError') as fingerprint, stage, count(*) as n, count(distinct session_id) as calls from ops where {FAILED_SQL} group by 1, 2 order by n desc, fingerprint, stage limit 12")
def a11(spark, d):
    return measures.failure_summary(facts.failure_facts(operations(spark, d)))


_CHAIN = """, linked as (select session_id, op_id::varchar as turn_id, case when op_id % 5 = 0 then lag(op_id) over (partition by session_id order by started_ms, op_id)::varchar when op_id % 97 = 1 then 'gone' end as continues_turn from ops)"""


@query("A13_fold_roots", "with recursive " + OPS[5:].strip() + _CHAIN + """, walk as (
    select session_id, turn_id, turn_id as root from linked l where continues_turn is null or not exists (select 1 from linked p where p.session_id = l.session_id and p.turn_id = l.continues_turn)
    union all select l.session_id, l.turn_id, w.root from linked l join walk w on l.session_id = w.session_id and l.continues_turn = w.turn_id)
    select l.session_id, l.turn_id, coalesce(w.root, l.turn_id) as root from linked l left join walk w on w.turn_id = l.turn_id""")
def a13(spark, d):
    ops = operations(spark, d)
    before = F.lag("op_id").over(Window.partitionBy("session_id").orderBy("started_ms", "op_id")).cast("string")
    linked = ops.select("session_id", F.col("op_id").cast("string").alias("turn_id"), F.when(F.col("op_id") % 5 == 0, before).when(F.col("op_id") % 97 == 1, "gone").alias("continues_turn"))
    return facts.fold_roots(linked).select("session_id", "turn_id", "root")


@query("A21_facets", FACTS + "select dimension, value, max(started_ms) as last_seen_ms from (select 'agent_id' as dimension, agent_id as value, started_ms from turns union all select 'stt_provider', stt_provider, started_ms from turns union all select 'tts_provider', tts_provider, started_ms from turns) f where value is not null group by 1, 2")
def a21(spark, d):
    return measures.facets(turns_of(spark, d), ["agent_id", "stt_provider", "tts_provider"])


@query("A22_freshness", FACTS + "select min(started_ms) as first_ms, max(started_ms) as last_ms from calls")
def a22(spark, d):
    return calls_of(spark, d).agg(F.min("started_ms").alias("first_ms"), F.max("started_ms").alias("last_ms"))


@query("A23_session_list", OPS + f"select session_id, count(distinct turn_id) as turns, count(*) filter ({FAILED_SQL}) as failed_ops from ops group by session_id")
def a23(spark, d):
    return facts.flagged(operations(spark, d)).groupBy("session_id").agg(F.countDistinct("turn_id").alias("turns"), F.count_if("failed").alias("failed_ops"))


@query("A30_cost_model", FACTS + "select session_id, round(0.0048 * 83 * duration_ms / 60000, 3) as per_call_production, round(0.0065 * 83 * duration_ms / 60000, 3) as per_call_challenger, round((0.0065 * 83 - 0.0048 * 83) * 159600, 3)::double as per_month_difference from calls")
def a30(spark, d):
    columns = cost.cost_columns(F.lit(0.0048), F.lit(0.0065), F.col("duration_ms") / 60000, F.lit(83.0), 42000 * 3.8)
    return calls_of(spark, d).select("session_id", *(F.round(columns[k], 3).alias(k) for k in ("per_call_production", "per_call_challenger", "per_month_difference")))


@query("A31_evaluation_cost", OPS + "select session_id, round(sum(amount), 6)::double as total, count(*) as components, count(*) = count(amount) as complete from (select session_id, turn_id, case when min(op_id) % 7 > 0 then min(op_id) * 0.25 end as amount from ops group by 1, 2) r group by session_id")
def a31(spark, d):
    runs = operations(spark, d).groupBy("session_id", F.col("turn_id").alias("run_id")).agg(F.min("op_id").alias("m")).withColumn("amount", F.when(F.col("m") % 7 > 0, F.col("m") * 0.25))
    return cost.evaluation_cost(runs.union(runs)).withColumn("total", F.round("total", 6))


@query("A32_cohort_rank", FACTS + "select agent_id, session_id, max_response_ms, round(s, 6) as share_below, round(s, 6) >= 0.1 and round(s, 6) <= 0.9 as typical from (select *, cume_dist() over (partition by agent_id order by max_response_ms) as s from (select *, row_number() over (partition by agent_id order by started_ms desc, session_id) as n from calls) a where n <= 25 and max_response_ms is not null) b")
def a32(spark, d):
    return measures.cohort_rank(calls_of(spark, d), "max_response_ms")


@query("A33_risk_summary", OPS + "select session_id, count(v) as evaluated, count(*) - count(v) as skipped, count(*) filter (v = 'none') as \"none\", count(*) filter (v = 'minor') as minor, count(*) filter (v = 'major') as major, sum(duration_ms)::bigint as tokens from (select *, case op_id % 4 when 0 then 'none' when 1 then 'minor' when 2 then 'major' end as v from ops) o group by session_id")
def a33(spark, d):
    v = F.when(F.col("op_id") % 4 == 0, "none").when(F.col("op_id") % 4 == 1, "minor").when(F.col("op_id") % 4 == 2, "major")
    return cost.risk_summary(operations(spark, d).withColumn("verdict", v).withColumn("tokens", F.col("duration_ms")))


@query("A36_response_gap", FACTS + """, clipped as (select o.session_id, o.turn_id, stage, greatest(o.started_ms, t.started_ms + 500) as s, least(o.ended_ms, t.ended_ms) as e from ops o join turns t on t.turn_id = o.turn_id and t.session_id = o.session_id where greatest(o.started_ms, t.started_ms + 500) < least(o.ended_ms, t.ended_ms)),
    marked as (select *, case when s > coalesce(max(e) over (partition by turn_id, stage order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as n from clipped),
    islands as (select session_id, turn_id, stage, g, max(e) - min(s) as c from (select *, sum(n) over (partition by turn_id, stage order by s, e rows unbounded preceding) as g from marked) m group by 1, 2, 3, 4),
    covered as (select session_id, turn_id, stage, sum(c)::bigint as c from islands group by 1, 2, 3)
    select session_id, turn_id, max(c) as top_ms, (list(stage order by c desc, stage desc))[1] as top_stage, sum(c)::bigint as total_ms from covered group by 1, 2""")
def a36(spark, d):
    ops = operations(spark, d)
    gaps = facts.turn_facts(ops).select("session_id", "turn_id", (F.col("started_ms") + 500).alias("from_ms"), F.col("ended_ms").alias("to_ms"))
    return intervals.response_gap(gaps, ops.select("session_id", "turn_id", "stage", "started_ms", "ended_ms"))


@query("A37_downsample", "select event_type, event_id // 100 as bucket, max(round_even(abs(value), 0)::bigint) as level from events group by 1, 2")
def a37(spark, d):
    fine = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 10).alias("bucket")).agg(F.max(F.bround(F.abs("value")).cast("long")).alias("level"))
    return challenger.downsampled(fine, 10, ["event_type"])


@query("A38_call_kpis", OPS + f"select session_id, quantile_disc(duration_ms, 0.5)::double as p50, quantile_disc(duration_ms, 0.95)::double as p95, max(duration_ms) as slowest, count(*) filter ({FAILED_SQL}) as failed, count(distinct tool_name) as tools, count(distinct provider) as providers from ops group by session_id")
def a38(spark, d):
    return facts.flagged(operations(spark, d)).groupBy("session_id").agg(measures.nearest_rank("duration_ms", 0.5).alias("p50"), measures.nearest_rank("duration_ms", 0.95).alias("p95"), F.max("duration_ms").alias("slowest"), F.count_if("failed").alias("failed"), F.countDistinct("tool_name").alias("tools"), F.countDistinct("provider").alias("providers"))


@query("A40_milestone_merge", OPS + "select session_id, stage, min(started_ms) as first_ms, max(started_ms) as last_ms, count(*) as n from ops group by 1, 2")
def a40(spark, d):
    return operations(spark, d).groupBy("session_id", "stage").agg(F.min("started_ms").alias("first_ms"), F.max("started_ms").alias("last_ms"), F.count("*").alias("n"))


@query("W01_slowest_turn", FACTS + f"select session_id, (list(turn_id order by response_ms desc nulls last, started_ms, turn_id))[1] as slowest_turn, (list(turn_id order by started_ms, turn_id) filter ({_FAILED} > 0))[1] as first_failed from turns group by session_id")
def w01(spark, d):
    turns = turns_of(spark, d)
    failed = F.when(F.expr(measures.FAILED) > 0, F.struct("started_ms", "turn_id"))
    slow = F.min_by("turn_id", F.struct((-F.coalesce("response_ms", F.lit(-1))).alias("s"), "started_ms", "turn_id"))
    return turns.groupBy("session_id").agg(slow.alias("slowest_turn"), F.min(failed)["turn_id"].alias("first_failed"))


@query("W02_mapping_windows", FACTS + "select session_id, turn_id, case when stt_ops > 0 then started_ms else coalesce(least(last_value(ended_ms) over (partition by session_id order by started_ms, turn_id rows between unbounded preceding and 1 preceding), started_ms), 0) end as window_from, ended_ms as window_to from turns")
def w02(spark, d):
    return intervals.mapping_windows(turns_of(spark, d).withColumn("worded", F.col("stt_ops") > 0))


@query("W03_interval_merge", OPS + """select session_id, g::bigint as island, min(s) as from_ms, max(e) as to_ms, max(e) - min(s) as speaking_ms from (select *, sum(n) over (partition by session_id order by s, e rows unbounded preceding) as g from (select session_id, started_ms as s, ended_ms as e,
    case when coalesce(started_ms > max(ended_ms) over (partition by session_id order by started_ms, ended_ms rows between unbounded preceding and 1 preceding) + 200, true) then 1 else 0 end as n from ops) x) y group by 1, 2""")
def w03(spark, d):
    return intervals.merged(operations(spark, d).select("session_id", "started_ms", "ended_ms"), ["session_id"])


@query("W04_midpoint_windows", FACTS + "select session_id, turn_id, coalesce((lag(ended_ms) over w + started_ms) // 2, started_ms) as window_from, coalesce((ended_ms + lead(started_ms) over w) // 2, ended_ms) as window_to from turns window w as (partition by session_id order by started_ms, turn_id)")
def w04(spark, d):
    return intervals.midpoint_windows(turns_of(spark, d))


@query("W05_newest_per_agent", FACTS + "select agent_id, session_id, n::integer as rank from (select *, row_number() over (partition by agent_id order by started_ms desc, session_id) as n from calls) c where n <= 25")
def w05(spark, d):
    rank = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.col("started_ms").desc(), "session_id"))
    return calls_of(spark, d).withColumn("rank", rank).filter("rank <= 25").select("agent_id", "session_id", "rank")


@query("W07_first_changed_partial", "select conv_id, arg_min(text, turn) as text, min(turn) as at_ms from (select *, lag(text) over (partition by conv_id order by turn, role) as b from conversations) c where text is distinct from b and text <> '' group by conv_id")
def w07(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "text", F.col("turn").alias("at_ms"), F.col("role").alias("seq"))
    return challenger.first_changed_partial(rows, ["conv_id"])


@query("W09_playout_clock", OPS + "select op_id, p + max(a - p) over (partition by session_id order by op_id) as playout_ms from (select op_id, session_id, started_ms as a, coalesce(sum(duration_ms) over (partition by session_id order by op_id rows between unbounded preceding and 1 preceding), 0)::bigint as p from ops) o")
def w09(spark, d):
    return intervals.playout_clock(operations(spark, d).withColumn("seq", F.col("op_id")).withColumn("arrival_ms", F.col("started_ms")), ["session_id"]).select("op_id", "playout_ms")


@query("W12_voice_transcript", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn, role) as transcript from conversations group by conv_id")
def w12(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # one call's turns
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("transcript"))


@query("W13_sample_cap", OPS + "select stage, op_id, total > 100 as truncated from (select stage, op_id, row_number() over (partition by stage order by started_ms, op_id) as n, count(*) over (partition by stage) as total from ops) o where n <= 100")
def w13(spark, d):
    ops = operations(spark, d).select("stage", "op_id", "started_ms")
    totals = ops.groupBy("stage").agg(F.count("*").alias("total"))
    return measures.newest(ops, ["stage"], [F.col("started_ms"), F.col("op_id")], 100).join(totals, "stage").select("stage", "op_id", (F.col("total") > 100).alias("truncated"))


@query("T03_tool_ranking", OPS + "select tool_name, row_number() over (order by n >= 5 desc, p95 desc, tool_name)::integer as place from (select tool_name, count(*) as n, quantile_disc(duration_ms, 0.95)::double as p95 from ops where stage = 'tool' group by 1) t")
def t03(spark, d):
    tools = measures.tool_summary(facts.tool_facts(operations(spark, d)))
    return tools.select("tool_name", F.row_number().over(Window.orderBy(F.col("rankable").desc(), F.col("p95").desc(), "tool_name")).alias("place"))


@query("T07_quota_sample", FACTS + "select session_id from (select session_id, failed_ops, row_number() over (partition by failed_ops > 0 order by started_ms desc, session_id) as newest, row_number() over (partition by failed_ops > 0 order by duration_ms desc, session_id) as longest from calls) c where (failed_ops > 0 and newest <= 5) or (failed_ops = 0 and longest <= 45)")
def t07(spark, d):
    calls = calls_of(spark, d).withColumn("failing", F.col("failed_ops") > 0)
    failed = measures.newest(calls.filter("failing"), ["failing"], [F.col("started_ms").desc(), F.col("session_id")], 5)
    return failed.union(measures.newest(calls.filter("not failing"), ["failing"], [F.col("duration_ms").desc(), F.col("session_id")], 45)).select("session_id")


@query("U02_facet_except", OPS + "select distinct agent_id || '/' || provider || '/' || stage as value from ops except select agent_id || '/' || provider || '/' || stage from ops where status = 'ok' and started_ms >= 1706000000000")
def u02(spark, d):
    """Facets of all operations that no good one of late carries."""
    ops = operations(spark, d)
    value = F.concat_ws("/", "agent_id", "provider", "stage").alias("value")
    return ops.select(value).distinct().subtract(ops.filter("status = 'ok' and started_ms >= 1706000000000").select(value))


@query("U03_distinct_providers", FACTS + "select distinct p as provider from (select stt_provider as p from turns union all select llm_provider from turns union all select tts_provider from turns) t where p is not null")
def u03(spark, d):
    return turns_of(spark, d).select(F.explode(F.array("stt_provider", "llm_provider", "tts_provider")).alias("provider")).filter("provider is not null").distinct()


def _pairs(spark, d):
    """Turns of conversations, and the same with each 7th word lost and the 3rd changed."""
    words = F.filter(F.split(F.lower(F.col("text")), r"\s+"), lambda w: w != "")
    kept = F.filter(F.transform(F.col("p"), lambda w, i: F.when((i + 1) % 7 != 0, F.when(i == 2, "zzz").otherwise(w))), lambda w: w.isNotNull())
    rows = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", "role", words.alias("p"))
    return rows.withColumn("c", kept).select("conv_id", "turn", "role", F.array_join("p", " ").alias("production"), F.array_join("c", " ").alias("challenger"))


_TEXTS = "from conversations where text is not null"
_NORM = r"trim(regexp_replace(regexp_replace(replace(lower(text), '$', ' dollars '), '[^\p{L}\p{M}\p{N}''\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("X01_normalize", f"select conv_id, turn, role, {_NORM} as norm {_TEXTS}")
def x01(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", "role", text.normalized(F.col("text")).alias("norm"))


#: Numbers spelt out, which become digits.
_NUMBERS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in text.NUMBER_WORDS.items()) + "}"


def words_sql(value: str) -> str:
    norm = rf"trim(regexp_replace(regexp_replace(replace({value}, '$', ' dollars '), '[^\p{{L}}\p{{M}}\p{{N}}''\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"list_transform(list_filter(string_split({norm}, ' '), lambda w: w <> ''), lambda w: coalesce(map_extract({_NUMBERS}, w)[1], w))"


@query("X02_tokenize", f"select conv_id, turn, role, len(t)::bigint as n, array_to_string(t, ' ') as tokens, array_to_string(s, ' ') as surfaces from (select conv_id, turn, role, {words_sql('lower(text)')} as t, list_filter(string_split({_NORM}, ' '), lambda w: w <> '') as s {_TEXTS}) x")
def x02(spark, d):
    rows = table(spark, d, "conversations").filter("text is not null").withColumn("norm", text.normalized(F.col("text")))
    return rows.select("conv_id", "turn", "role", F.size(text.tokens(F.col("norm"))).cast("long").alias("n"), F.array_join(text.tokens(F.col("norm")), " ").alias("tokens"), F.array_join(text.surfaces(F.col("norm")), " ").alias("surfaces"))


#: pairs (conv_id, turn, role, production, challenger, l, r), then errors row by row of the edit table.
PAIRS_SQL = (
    r"with split as (select conv_id, turn, role, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') as p from conversations where text is not null), "
    "said as (select conv_id, turn, role, array_to_string(p, ' ') as production, array_to_string(list_filter(list_transform(p, lambda w, i: case when i % 7 <> 0 then case when i = 3 then 'zzz' else w end end), lambda w: w is not null), ' ') as challenger from split), "
    f"pairs as (select *, {words_sql('production')} as l, {words_sql('challenger')} as r from said), "
)
#: The edit table of list columns l and r, a row for each token of l.
EDITS_SQL = """recursive_edits as (
  with recursive step as (
    select k, l, r, 0 as i, range(0, len(r) + 1) as costs from asked
    union all
    select k, l, r, i + 1, list_reduce(
      list_transform(range(1, len(r) + 1), lambda j: [least(costs[j] + (case when r[j] = l[i + 1] then 0 else 1 end), costs[j + 1] + 1)]),
      lambda done, x: list_append(done, least(x[1], done[len(done)] + 1)), [(i + 1)::bigint]) from step where i < len(l)
  ) select k, costs[len(costs)] as errors from step where i = len(l)
)"""
_SCORED_SQL = PAIRS_SQL + "asked as (select struct_pack(conv_id := conv_id, turn := turn, role := role) as k, l, r from pairs), " + EDITS_SQL + """, scored as (
  select p.conv_id, p.turn, p.role, case when production = '' and challenger = '' then 'no_speech' when challenger = '' then 'challenger_empty' when production = '' then 'possible_missed_speech' else 'evaluated' end as status,
    len(r)::bigint as words, e.errors::bigint as raw from pairs p join recursive_edits e on e.k.conv_id = p.conv_id and e.k.turn = p.turn and e.k.role = p.role
), rated as (select *, case status when 'evaluated' then raw when 'possible_missed_speech' then words else 0 end as errors, case when status = 'possible_missed_speech' then 1.0 when status = 'evaluated' and words > 0 then raw / words end as wer from scored) """


@query("X03_align")
def x03(spark, d):
    rows = _pairs(spark, d).withColumn("diff", text.align(text.tokens(text.normalized(F.col("production"))), text.tokens(text.normalized(F.col("challenger")))))
    return rows.select("conv_id", "turn", "role", F.explode("diff").alias("x")).groupBy("conv_id", "turn", "role").agg(*(F.count_if(F.col("x.operation") == o).alias(o) for o in ("match", "substitution", "insertion", "deletion")))


@query("X04_token_edit_distance", PAIRS_SQL + "asked as (select struct_pack(conv_id := conv_id, turn := turn, role := role) as k, r as l, list_reverse(l) as r from pairs), " + EDITS_SQL + " select k.conv_id as conv_id, k.turn as turn, k.role as role, errors::bigint as errors from recursive_edits")
def x04(spark, d):
    """The challenger's words against production's read backwards."""
    left, right = (text.tokens(text.normalized(F.col(c))) for c in ("challenger", "production"))
    return _pairs(spark, d).select("conv_id", "turn", "role", text.token_edit_distance(left, F.reverse(right)).cast("long").alias("errors"))


def scored_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", "role", text.scored_pair(F.col("production"), F.col("challenger")).alias("s")).select("conv_id", "turn", "role", "s.*")


_BAND = "case when wer is null then 'unavailable' when wer < 0.1 then 'low' when wer <= 0.25 then 'moderate' else 'high' end"


@query("X05_score_pair", _SCORED_SQL + f"select conv_id, turn, role, status, errors, words, wer::double as wer, {_BAND} as band from rated")
def x05(spark, d):
    return scored_pairs(spark, d)


@query("X06_band", _SCORED_SQL + f"select {_BAND} as band, count(*) as turns from rated group by 1")
def x06(spark, d):
    return scored_pairs(spark, d).groupBy("band").agg(F.count("*").alias("turns"))


@query("A24_call_wer", _SCORED_SQL + "select conv_id, sum(errors)::bigint as errors, sum(words)::bigint as words, case when sum(words) > 0 then round(sum(errors) / sum(words), 6) end::double as wer from rated group by conv_id")
def a24(spark, d):
    scored = scored_pairs(spark, d)
    return scored.groupBy("conv_id").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words")).withColumn("wer", F.round(F.try_divide("errors", "words"), 6))


def aligned_turns(spark, d):
    """Turns of conversations with one word in seven lost and the third changed, aligned."""
    rows = _pairs(spark, d).withColumn("turn_id", F.concat_ws("/", F.lpad(F.col("turn").cast("string"), 6, "0"), "role")).withColumn("at", F.col("turn"))
    return text.aligned_texts(rows, "production", "challenger")


@query("A25_disagreed_words")
def a25(spark, d):
    """Of each call, the words that disagree most."""
    return text.disagreed_words(aligned_turns(spark, d), ["conv_id"])


@query("X10_changed_words")
def x10_changed(spark, d):
    changed = aligned_turns(spark, d).select("conv_id", "turn", "role", F.explode(text.changed_words(F.col("diff"))).alias("x"))
    return changed.select("conv_id", "turn", "role", "x.*")


@query("X07_cer", "select o_orderkey, round(levenshtein(o_orderpriority, p_name) / length(p_name), 6) as cer from orders join (select p_partkey, lower(p_name) as p_name from part where p_name is not null and p_name <> '') p on p_partkey = o_orderkey % 500 + 1")
def x07(spark, d):
    parts = table(spark, d, "part").filter("p_name is not null and p_name <> ''").select("p_partkey", F.lower("p_name").alias("p_name"))
    return table(spark, d, "orders").join(parts, F.col("p_partkey") == F.col("o_orderkey") % 500 + 1).select("o_orderkey", F.round(text.character_error_rate(F.col("o_orderpriority"), F.col("p_name")), 6).alias("cer"))


@query("Q04_monitors", FACTS + "select r.rule_id, coalesce(r.agent_id, '__all__') as scope, r.stat, round(case stat when 'p50' then p50 when 'p95' then p95 else mean end, 6)::double as observed, case when not coalesce(case when stat = 'p95' then n >= 20 else n >= 5 end, false) then 'no_data' when (above and (case stat when 'p50' then p50 when 'p95' then p95 else mean end) > threshold) or (not above and (case stat when 'p50' then p50 when 'p95' then p95 else mean end) < threshold) then 'alerting' else 'ok' end as state from (values (1, 'p95', true, 8000.0, null), (2, 'p50', true, 500.0, 'agent-2'), (3, 'mean', false, 100.0, 'agent-4'), (4, 'p50', true, 1.0, 'agent-99')) r(rule_id, stat, above, threshold, agent_id) left join (select scope, count(response_ms) as n, quantile_disc(response_ms, 0.5)::double as p50, quantile_disc(response_ms, 0.95)::double as p95, round(avg(response_ms), 6) as mean from (select *, unnest(['__all__', agent_id]) as scope from turns) s group by scope) t on t.scope = coalesce(r.agent_id, '__all__')")
def q04(spark, d):
    rules = spark.createDataFrame([(1, "p95", True, 8000.0, None), (2, "p50", True, 500.0, "agent-2"), (3, "mean", False, 100.0, "agent-4"), (4, "p50", True, 1.0, "agent-99")], "rule_id int, stat string, above boolean, threshold double, agent_id string")
    return reports.monitors(turns_of(spark, d), rules)


@query("Q05_session_detail", OPS + "select turn_id, count(*) as ops, sum(duration_ms)::bigint as busy_ms, string_agg(stage, '>' order by started_ms, op_id) as trace from ops group by turn_id")
def q05(spark, d):
    trace = F.array_sort(F.collect_list(F.struct("started_ms", "op_id", "stage")))  # the spans of one turn
    return operations(spark, d).groupBy("turn_id").agg(F.count("*").alias("ops"), F.sum("duration_ms").alias("busy_ms"), F.array_join(F.transform(trace, lambda x: x["stage"]), ">").alias("trace"))
