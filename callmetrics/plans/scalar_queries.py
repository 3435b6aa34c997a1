"""Scalar rules, predicates and joins over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.functions import scalars as s
from callmetrics.operators import facts, intervals
from callmetrics.plans.registry import FACTS, FAILED_SQL, INTERRUPTED_SQL, OPS, query
from callmetrics.sources.binding import DAY_MS, operations, table
from callmetrics.sources.packages import overlaid, replaced

ENVIRONMENTS = (("production", 0.78), ("staging", 0.22))


def turns_of(spark: SparkSession, d: str) -> DataFrame:
    return facts.turn_facts(operations(spark, d))


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    return facts.call_facts(turns_of(spark, d))


@query("P03_delta", OPS + "select op_id, case when ended_ms >= started_ms then ended_ms - started_ms end as gap, started_ms - ended_ms as signed_gap from ops")
def p03(spark, d):
    return operations(spark, d).select("op_id", s.delta(F.col("ended_ms"), F.col("started_ms")).alias("gap"), s.delta(F.col("started_ms"), F.col("ended_ms"), True).alias("signed_gap"))


@query("P04_independent_delta", OPS + "select op_id, case when ended_ms > started_ms then ended_ms - started_ms end as gap from ops")
def p04(spark, d):
    return operations(spark, d).select("op_id", s.independent_delta(F.col("ended_ms"), F.col("started_ms")).alias("gap"))


@query("P10_failure_flags", OPS + f"select op_id, coalesce(error_name in ('AbortError', 'CancelledError', 'CancelledException'), false) as aborted, {FAILED_SQL} as failed, {INTERRUPTED_SQL} as interrupted from ops")
def p10(spark, d):
    return facts.flagged(operations(spark, d)).select("op_id", s.is_abort(F.col("error_name")).alias("aborted"), "failed", "interrupted")


@query("P11_timeouts", OPS + f"select op_id from ops where {FAILED_SQL} and contains(lower(error_name), 'timeout')")
def p11(spark, d):
    return operations(spark, d).filter(s.is_timeout(F.col("status"), F.col("error_name"), F.lit(None))).select("op_id")


@query("P12_error_fingerprint", OPS + f"select op_id, stage || ':' || coalesce(error_name, 'UnknownError') as fingerprint from ops where {FAILED_SQL}")
def p12(spark, d):
    return facts.failure_facts(operations(spark, d)).select("op_id", "fingerprint")


@query("P13_canonical_provider", OPS + "select op_id, case provider when 'Deepgram' then 'deepgram' when 'deepgram-tts' then 'deepgram' when 'eastus.api.cognitive.microsoft.com' then 'azure-openai' when 'azure openai' then 'azure-openai' when 'My Vendor' then 'my-vendor' end as vendor from ops")
def p13(spark, d):
    return operations(spark, d).select("op_id", s.canonical_provider(F.col("provider")).alias("vendor"))


@query("P16_epoch_ms", "select event_id, epoch_us(ts) // 1000 as at_ms, cast(null as bigint) as none_ms from events")
def p16(spark, d):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return table(spark, d, "events").select("event_id", s.epoch_ms(iso).alias("at_ms"), s.epoch_ms(F.lit("not a time")).alias("none_ms"))


@query("P17_bucket_floor", OPS + f"select op_id, started_ms // 3600000 * 3600000 as hour_ms, started_ms // {DAY_MS} * {DAY_MS} as chosen_ms from ops")
def p17(spark, d):
    width = s.bucket_size_ms(30 * DAY_MS)  # 30 days at 48 buckets at most: days
    return operations(spark, d).select("op_id", s.bucket_floor(F.col("started_ms"), 3_600_000).alias("hour_ms"), s.bucket_floor(F.col("started_ms"), width).alias("chosen_ms"))


@query("P18_capture_incomplete", "select o_orderkey, o_orderstatus = 'P' or coalesce(o_orderkey % 11 = 0, false) as incomplete from orders")
def p18(spark, d):
    flag = s.capture_incomplete(F.col("o_orderstatus") != "P", F.lit(True), F.when(F.col("o_orderkey") % 11 == 0, 3), F.lit(None).cast("boolean"))
    return table(spark, d, "orders").select("o_orderkey", flag.alias("incomplete"))


@query("P19_session_status", "select o_orderkey, case when count(l_orderkey) > 0 and any_value(o_orderstatus) <> 'P' then 'ready' else 'partial' end as state from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def p19(spark, d):
    counts = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.first("o_orderstatus").alias("status"))
    return counts.select("o_orderkey", s.session_status(F.col("n"), F.col("status") != "P").alias("state"))


@query("P20_rate", FACTS + "select session_id, measured > 0 as available, case when measured > 0 then round(lag_turns / measured, 6) end as rate, case when measured = 0 then 'no_eligible_turns' end as reason from calls")
def p20(spark, d):
    return calls_of(spark, d).select("session_id", s.rate(F.col("lag_turns"), F.col("measured")).alias("r")).select("session_id", "r.available", F.round("r.rate", 6).alias("rate"), "r.reason")


@query("P21_latency_tone", OPS + "select op_id, case when duration_ms < 1800 then 'ok' when duration_ms < 3000 then 'warn' when duration_ms is not null then 'danger' end as tone from ops")
def p21(spark, d):
    return operations(spark, d).select("op_id", s.latency_tone(F.col("duration_ms")).alias("tone"))


@query("P28_redact_secrets", r"select doc_id, length(regexp_replace(text, '\bAKIA[0-9A-Z]{12,}', '[redacted]', 'g'))::bigint as n, len(regexp_extract_all(text, '\bAKIA[0-9A-Z]{12,}'))::bigint as found from documents")
def p28(spark, d):
    return table(spark, d, "documents").select("doc_id", s.redact_secrets(F.col("text")).alias("r")).select("doc_id", F.length("r.text").cast("long").alias("n"), "r.found")


@query("P29_pii_email", r"select doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'))::bigint as emails from documents")
def p29(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(s.EMAIL)).cast("long").alias("emails"))


@query("P29_pii_scan")
def p29_all(spark, d):
    return table(spark, d, "documents").select("doc_id", s.pii_scan(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("P30_weighted_choice", "select o_orderkey, case when ('0x' || substr(sha256(o_orderkey::varchar), 1, 8))::bigint / 4294967295.0 < 0.78 then 'production' else 'staging' end as environment from orders")
def p30(spark, d):
    return table(spark, d, "orders").select("o_orderkey", s.weighted_choice(ENVIRONMENTS, F.col("o_orderkey").cast("string")).alias("environment"))


@query("P31_enrich_model", "select c_custkey, coalesce(case when c_custkey % 3 = 0 then null else c_mktsegment end, n_name) as model from customer left join nation on n_nationkey = c_nationkey")
def p31(spark, d):
    missing = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    lookup = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(lookup, "c_nationkey", "left").select("c_custkey", F.coalesce(missing, F.col("n_name")).alias("model"))


@query("P33_verdict", "select o_orderkey, case when o_orderkey % 5 = 0 then 'unknown' when o_totalprice < 150000 then 'challenger' when o_totalprice > 150000 then 'production' else 'even' end as verdict from orders")
def p33(spark, d):
    return table(spark, d, "orders").select("o_orderkey", s.verdict(F.when(F.col("o_orderkey") % 5 != 0, F.lit(150000.0)), F.col("o_totalprice")).alias("verdict"))


@query("P34_billable_usage", OPS + "select op_id, round_even(duration_ms / 60, 3) as minutes from ops")
def p34(spark, d):
    return operations(spark, d).select("op_id", s.billable_minutes(F.col("duration_ms")).alias("minutes"))


@query("P38_bound_payload", "select doc_id, strlen(text) > 16384 as truncated, strlen(text)::bigint as original_bytes, case when strlen(text) > 16384 then substr(text, 1, 256) else text end as preview from documents")
def p38(spark, d):
    return table(spark, d, "documents").select("doc_id", s.bound_payload(F.col("text")).alias("b")).select("doc_id", "b.*")


@query("P39_scorecard", FACTS + "select session_id, case when failed_ops / turns < 0.1 then 'low' when failed_ops / turns <= 0.25 then 'moderate' else 'high' end as accuracy, case when max_response_ms < 1000 then 'good' when max_response_ms <= 1800 then 'watch' when max_response_ms is not null then 'act' end as wait, case when lag_turns >= 3 then 'act' when lag_turns >= 1 then 'watch' else 'good' end as risk from calls")
def p39(spark, d):
    return calls_of(spark, d).select("session_id", s.scorecard_rating(F.col("failed_ops") / F.col("turns"), F.col("max_response_ms"), F.col("lag_turns")).alias("r")).select("session_id", "r.*")


@query("P40_thin_metric", FACTS + "select session_id, measured * 2 < turns as thin from calls")
def p40(spark, d):
    return calls_of(spark, d).select("session_id", s.thin_metric(F.col("measured"), F.col("turns")).alias("thin"))


@query("S05_pricing_overlay", "select coalesce(d.k, o.k) as k, coalesce(o.rate, d.rate)::double as rate, coalesce(o.note, d.note) as note from (select n_name as k, n_nationkey * 1.5 as rate, 'default' as note from nation) d full join (select n_name as k, case when n_nationkey % 2 = 0 then 9.0 end as rate, 'own' as note from nation where n_nationkey % 3 = 0) o on d.k = o.k")
def s05(spark, d):
    nation = table(spark, d, "nation")
    default = nation.select(F.col("n_name").alias("k"), (F.col("n_nationkey") * 1.5).alias("rate"), F.lit("default").alias("note"))
    own = nation.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, 9.0).alias("rate"), F.lit("own").alias("note"))
    return overlaid(default, own, "k")


@query("S06_replace_session_facts", FACTS + "select session_id, turn_id, response_ms from turns where session_id not in (select session_id from calls where failed_ops > 1) union all select session_id, turn_id, -1 as response_ms from turns t where session_id in (select session_id from calls where failed_ops > 1) and stt_ops > 0")
def s06(spark, d):
    turns = turns_of(spark, d)
    again = turns.join(facts.call_facts(turns).filter("failed_ops > 1").select("session_id"), "session_id", "left_semi").filter("stt_ops > 0").select("session_id", "turn_id", F.lit(-1).cast("long").alias("response_ms"))
    resent = turns.join(facts.call_facts(turns).filter("failed_ops > 1").select("session_id"), "session_id", "left_semi")
    kept = turns.join(resent.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "turn_id", "response_ms")
    return replaced(kept, again, ["session_id"])


_FROM, _TO = 1_705_000_000_000, 1_706_500_000_000


@query("F02_turn_filter", FACTS + "select turn_id from turns where started_ms >= 1705000000000 and started_ms < 1706500000000 and session_id in (select session_id from calls where failed_ops > 0)")
def f02(spark, d):
    turns = turns_of(spark, d)
    return turns.filter((F.col("started_ms") >= _FROM) & (F.col("started_ms") < _TO)).join(facts.call_facts(turns).filter("failed_ops > 0"), "session_id", "left_semi").select("turn_id")


@query("F05_tool_filter", FACTS + "select session_id from calls where session_id in (select session_id from ops where tool_name = 'tool_3')")
def f05(spark, d):
    ops = operations(spark, d)
    return facts.call_facts(facts.turn_facts(ops)).join(ops.filter("tool_name = 'tool_3'"), "session_id", "left_semi").select("session_id")


@query("F07_operation_search", OPS + "select op_id from ops where status = 'error' and contains(lower(concat_ws(' ', provider, tool_name, error_name)), 'timeout')")
def f07(spark, d):
    return operations(spark, d).filter(F.col("status") == "error").filter(F.contains(F.lower(F.concat_ws(" ", "provider", "tool_name", "error_name")), F.lit("timeout"))).select("op_id")


@query("J01_semi_join", FACTS + "select turn_id from turns where session_id in (select session_id from calls where lag_turns > 0)")
def j01(spark, d):
    turns = turns_of(spark, d)
    return turns.join(facts.call_facts(turns).filter("lag_turns > 0"), "session_id", "left_semi").select("turn_id")


@query("J02_missing_or_stale", "select count(*) filter (l.k is null) as unbuilt, count(*) filter (l.v < 7) as stale, count(*) filter (l.v > 7) as newer from orders left join (select l_orderkey as k, max(l_linenumber) + 2 as v from lineitem group by 1) l on k = o_orderkey")
def j02(spark, d):
    built = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_linenumber") + 2).alias("v"))
    return table(spark, d, "orders").join(built, "o_orderkey", "left").agg(F.count_if(F.col("v").isNull()).alias("unbuilt"), F.count_if(F.col("v") < 7).alias("stale"), F.count_if(F.col("v") > 7).alias("newer"))


@query("J03_retired_facets", "select distinct c_mktsegment || '-' || c_nationkey || '-' || floor(c_acctbal / 1000)::bigint as facet from customer except select c_mktsegment || '-' || c_nationkey || '-' || floor(c_acctbal / 1000)::bigint from customer join orders on o_custkey = c_custkey where o_orderdate >= timestamp '1998-01-01'")
def j03(spark, d):
    """Facets of all customers that no customer with a recent order carries any more."""
    facet = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("facet")
    customer, recent = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz '1998-01-01'")
    live = customer.join(recent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(facet)
    return customer.select(facet).distinct().join(live, "facet", "left_anti")


@query("J04_without_continuations", OPS + "select session_id, count(distinct turn_id) as turns from ops where turn_id not in (select turn_id from ops where op_id % 9 = 0) group by session_id")
def j04(spark, d):
    ops = operations(spark, d)
    return ops.join(ops.filter("op_id % 9 = 0"), "turn_id", "left_anti").groupBy("session_id").agg(F.countDistinct("turn_id").alias("turns"))


_PAIRS = "a.session_id = b.session_id"


@query("J05_words_to_turns", FACTS + "select op_id as word_id, o.session_id, case when count(t.turn_id) = 0 then 'unmapped' when count(t.turn_id) > 1 then 'ambiguous' else 'mapped' end as mapping, case when count(t.turn_id) = 1 then min(t.turn_id) end as turn_id from ops o left join turns t on t.session_id = o.session_id and t.stt_ops > 0 and o.started_ms >= t.started_ms - 160 and o.started_ms < t.ended_ms + 160 group by op_id, o.session_id")
def j05(spark, d):
    ops = operations(spark, d)
    return intervals.words_to_turns(ops.select(F.col("op_id").alias("word_id"), "session_id", F.col("started_ms").alias("onset_ms")), facts.turn_facts(ops).filter("stt_ops > 0"))


@query("J06_midpoint_map", FACTS + "select o.op_id, t.turn_id from ops o join (select session_id, turn_id, coalesce((lag(ended_ms) over w + started_ms) // 2, started_ms) as a, coalesce((ended_ms + lead(started_ms) over w) // 2, ended_ms) as b from turns window w as (partition by session_id order by started_ms, turn_id)) t on o.session_id = t.session_id and (o.started_ms + o.ended_ms) // 2 >= a and (o.started_ms + o.ended_ms) // 2 < b")
def j06(spark, d):
    ops = operations(spark, d)
    windows = intervals.midpoint_windows(facts.turn_facts(ops)).select("session_id", F.col("turn_id").alias("own"), F.col("turn_id").alias("r_id"), F.col("window_from").alias("r_from"), F.col("window_to").alias("r_to"))
    mid = F.floor((F.col("started_ms") + F.col("ended_ms")) / 2)
    points = ops.select("session_id", "op_id", F.col("op_id").alias("l_id"), mid.alias("l_from"), (mid + 1).alias("l_to"))
    return intervals.overlaps(points, windows, ["session_id"]).filter("l_from >= r_from and l_from < r_to").select("op_id", F.col("own").alias("turn_id"))


@query("J07_logical_llm_calls", OPS + "select op_id from ops o where stage = 'llm' and not (op_id % 2 = 1 and exists (select 1 from ops f where f.stage = 'llm' and f.op_id % 2 = 0 and f.session_id = o.session_id and f.turn_id = o.turn_id and o.started_ms between f.started_ms and f.ended_ms))")
def j07(spark, d):
    return facts.logical_llm_calls(operations(spark, d).withColumn("has_tokens", F.col("op_id") % 2 == 0)).select("op_id")


def _sides(spark, d, left: str, right: str, reach: int):
    ops = operations(spark, d)
    end = (F.col("started_ms") + F.lit(reach)).cast("long")
    side = lambda stage, p: ops.filter(F.col("stage") == stage).select("session_id", F.col("op_id").alias(f"{p}_id"), F.col("started_ms").alias(f"{p}_from"), end.alias(f"{p}_to"))
    return side(left, "l"), side(right, "r")


_HOURS = 7_200_000


@query("J09_nearest_counterpart", OPS + f"select session_id, l_id, r_id from (select a.session_id, a.op_id as l_id, b.op_id as r_id, row_number() over (partition by a.op_id order by abs(a.started_ms - b.started_ms), b.op_id) as n from ops a join ops b on {_PAIRS} and a.stage = 'llm' and b.stage = 'tts' and a.started_ms < b.started_ms + {_HOURS} and b.started_ms < a.started_ms + {_HOURS}) where n = 1")
def j09(spark, d):
    return intervals.nearest_counterpart(*_sides(spark, d, "llm", "tts", _HOURS))


@query("J08_tightest_enclosing", OPS + f"select session_id, l_id, r_id from (select a.session_id, a.op_id as l_id, b.op_id as r_id, row_number() over (partition by a.op_id order by b.started_ms desc, b.op_id desc) as n from ops a join ops b on {_PAIRS} and a.stage = 'tool' and b.stage = 'llm' and a.started_ms >= b.started_ms - 500 and a.ended_ms <= b.started_ms + {_HOURS} + 500) where n = 1")
def j08(spark, d):
    ops = operations(spark, d)
    left = ops.filter("stage = 'tool'").select("session_id", F.col("op_id").alias("l_id"), F.col("started_ms").alias("l_from"), F.col("ended_ms").alias("l_to"))
    return intervals.tightest_enclosing(left, _sides(spark, d, "tool", "llm", _HOURS)[1])


@query("J10_first_agent_audio", OPS + f"select a.op_id, min(b.started_ms) as first_ms from ops a join ops b on {_PAIRS} and a.stage = 'tts' and b.started_ms >= a.started_ms and b.started_ms < a.started_ms + {_HOURS} and b.stage = 'llm' group by a.op_id")
def j10(spark, d):
    left, right = _sides(spark, d, "tts", "llm", _HOURS)
    return intervals.overlaps(left, right.withColumn("r_to", F.col("r_from") + 1), ["session_id"]).groupBy(F.col("l_id").alias("op_id")).agg(F.min("r_from").alias("first_ms"))


@query("J11_barge_in", OPS + f"""select c.session_id, c.op_id::varchar as turn_id, sum(least(c.started_ms + {_HOURS}, i.b) - greatest(c.started_ms, i.a))::bigint as overlap_ms from ops c join (
    select session_id, min(s) as a, max(e) as b from (select *, sum(n) over (partition by session_id order by s, e rows unbounded preceding) as g from (select session_id, started_ms as s, started_ms + {_HOURS} as e,
    case when started_ms > max(started_ms + {_HOURS}) over (partition by session_id order by started_ms, started_ms + {_HOURS} rows between unbounded preceding and 1 preceding) + 200 then 1 else 0 end as n from ops where stage = 'tts') x) y group by session_id, g) i
    on c.session_id = i.session_id and c.stage = 'stt' and c.started_ms < i.b and i.a < c.started_ms + {_HOURS} group by 1, 2 having overlap_ms >= 300""")
def j11(spark, d):
    ops = operations(spark, d).withColumn("ended_ms", (F.col("started_ms") + _HOURS).cast("long"))
    return intervals.barge_in(ops.filter("stage = 'stt'").withColumn("turn_id", F.col("op_id").cast("string")), ops.filter("stage = 'tts'").select("session_id", "started_ms", "ended_ms"))


@query("J12_cancel_reason", OPS + f"select a.op_id, case when count(b.op_id) > 0 then 'barge_in' else 'stopped' end as reason from ops a left join ops b on {_PAIRS} and b.stage = 'stt' and b.turn_id <> a.turn_id and a.started_ms < b.started_ms + 86400000 and b.started_ms < a.started_ms + 86400000 where {INTERRUPTED_SQL.replace('status', 'a.status').replace('error_name', 'a.error_name')} group by a.op_id")
def j12(spark, d):
    ops = facts.flagged(operations(spark, d))
    end = F.col("started_ms") + DAY_MS
    cut = ops.filter("interrupted").select("session_id", F.col("op_id").alias("l_id"), F.col("turn_id").alias("l_turn"), F.col("started_ms").alias("l_from"), end.alias("l_to"))
    caller = ops.filter("stage = 'stt'").select("session_id", F.col("op_id").alias("r_id"), F.col("turn_id").alias("r_turn"), F.col("started_ms").alias("r_from"), end.alias("r_to"))
    hit = intervals.overlaps(cut, caller, ["session_id"], DAY_MS).filter("l_turn <> r_turn").select("l_id").distinct().withColumn("hit", F.lit(True))
    return cut.join(hit, "l_id", "left").select(F.col("l_id").alias("op_id"), F.when(F.col("hit"), "barge_in").otherwise("stopped").alias("reason"))


@query("J15_rate_lookup", OPS + "select op_id, coalesce(e.rate, l.rate)::double as rate from ops left join (values ('Deepgram', 0.0048), ('llm', 0.01)) e(k, rate) on provider = e.k left join (values ('my vendor', 'llm')) a(alias, k) on lower(provider) = a.alias left join (values ('Deepgram', 0.0048), ('llm', 0.01)) l(k, rate) on l.k = a.k")
def j15(spark, d):
    rates = spark.createDataFrame([("Deepgram", 0.0048), ("llm", 0.01)], "k string, rate double")
    alias = spark.createDataFrame([("my vendor", "llm")], "alias string, k string").join(rates, "k").select("alias", F.col("rate").alias("alias_rate"))
    ops = operations(spark, d).select("op_id", "provider")
    return ops.join(rates, F.col("provider") == F.col("k"), "left").join(alias, F.lower("provider") == F.col("alias"), "left").select("op_id", F.coalesce("rate", "alias_rate").alias("rate"))


@query("J16_enclosed_removed", OPS + "select a.op_id from ops a where stage = 'llm' and not exists (select 1 from ops b where b.stage = 'llm' and b.session_id = a.session_id and b.op_id <> a.op_id and b.started_ms <= a.started_ms and b.ended_ms >= a.ended_ms and not (b.started_ms = a.started_ms and b.ended_ms = a.ended_ms))")
def j16(spark, d):
    return intervals.outermost(operations(spark, d).filter("stage = 'llm'"), ["session_id"]).select("op_id")


@query("J17_verdict_cache", "select d.doc_id, c.doc_id is null as pending from documents d left join (select doc_id, md5(text) as f from documents where doc_id % 2 = 0) c on c.doc_id = d.doc_id and c.f = md5(case when d.doc_id % 10 = 0 then d.text || '!' else d.text end)")
def j17(spark, d):
    docs = table(spark, d, "documents")
    cached = docs.filter("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.lit(True).alias("known"))
    now = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("fingerprint"))
    return now.join(cached, ["doc_id", "fingerprint"], "left").select("doc_id", F.col("known").isNull().alias("pending"))


@query("J18_cache_drift", FACTS + "select session_id, 'turns' as field, turns::varchar as recomputed, (turns + 1)::varchar as stored from calls where failed_ops % 4 = 1")
def j18(spark, d):
    now = calls_of(spark, d)
    stored = now.withColumn("turns", F.when(F.col("failed_ops") % 4 == 1, F.col("turns") + 1).otherwise(F.col("turns")))
    fields = ["turns", "failed_ops", "measured"]
    long = lambda df, name: df.select("session_id", *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(["session_id"], fields, "field", name)
    return long(now, "recomputed").join(long(stored, "stored"), ["session_id", "field"], "full").filter(~F.col("recomputed").eqNullSafe(F.col("stored")))
