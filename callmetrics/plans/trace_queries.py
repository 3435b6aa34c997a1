"""Traces of calls, and findings against a second way of measuring them."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.operators import findings, measures, trace
from callmetrics.plans.package_queries import stt_of
from callmetrics.plans.package_queries import turns_of as package_turns
from callmetrics.plans.registry import query
from callmetrics.sources import nested
from callmetrics.sources.nested import NESTED_SQL

_KINDS = {
    "stt": ("true", "b", "b + 1200"), "llm": ("true", "b + 1200", "b + 1200 + v"), "try": ("e % 4 = 0", "b + 1200", "b + 1210"), "tts": ("stage <> 'stt'", "b + 1200 + v", "b + 1900 + v"), "tool": ("stage = 'tool'", "b + 1300", "b + 1300 + v"),
    "socket": ("e % 15 = 0", "b", "b + 5000"),
}
_SPANS = ", sp as (" + " union all ".join(
    f"select session_id, {'null' if k == 'socket' else 'e::varchar'} as turn_id, e || '-{k}' as event_id, '{dict(socket='stt', **{'try': 'llm'}).get(k, k)}' as type, '{k}' as kind, {a} as s, {b} as t from bound where {when}" for k, (when, a, b) in _KINDS.items()
) + ")"


@query("Q05_session_trace", NESTED_SQL.replace("with ", "with recursive ", 1) + _SPANS + """, inside as (select a.event_id, arg_max(b.event_id, struct_pack(x := b.s, y := -b.t, z := b.event_id)) as up from sp a join sp b on a.session_id = b.session_id and a.kind <> 'socket' and b.kind <> 'socket' and b.s <= a.s and b.t >= a.t and (b.s < a.s or b.t > a.t or b.event_id < a.event_id) group by 1),
    served as (select a.event_id, arg_max(b.event_id, struct_pack(x := b.s, z := b.event_id)) as host from sp a join sp b on a.kind = 'try' and b.kind = 'llm' and a.session_id = b.session_id and a.turn_id = b.turn_id and a.s >= b.s - 500 and a.t <= b.t + 500 group by 1),
    deep as (select event_id, 0 as depth from sp where event_id not in (select event_id from inside) union all select i.event_id, d.depth + 1 from inside i join deep d on d.event_id = i.up),
    told as (select session_id, case when kind = 'socket' then 'sockets' else 'turn:' || turn_id end as section, sp.event_id, type, host as parent_id, up as enclosing_id, depth::bigint as depth, s from sp left join inside using (event_id) left join served using (event_id) join deep using (event_id))
    select * exclude (s), row_number() over (partition by session_id, section, parent_id order by s, event_id)::integer as place from told""")
def q05_trace(spark, d):
    return trace.session_trace(nested.spans_of(spark, d), package_turns(spark, d))


@query("G02_independent_recompute", NESTED_SQL + """select * replace (expected::double as expected, actual::double as actual) from (select session_id, turn_id, 'evidence' as category, 'time_to_first_partial_ms' as field, 300.0 - case when worded then 100 else 0 end as expected, 307.0 - case when worded then 100 else 0 end as actual from heard where e % 50 = 0
    union all select session_id, turn_id, case when final <> declared then 'evidence' else 'absence' end, 'endpoint_delay_ms', case when final <> declared then final - declared end, -1 from heard where e % 50 = 1
    union all select session_id, turn_id, 'evidence', 'missing_final', (e % 7 = 0)::integer, 1 - (e % 7 = 0)::integer from heard where e % 50 = 3
    union all select session_id, turn_id, 'invariant', 'turn', 1, null from heard where e % 50 = 2) f""")
def g02(spark, d):
    """Every timing of every recognition against a second implementation, of a copy with
    four kinds of seeded faults: one finding a fault, and none for the rest."""
    stt = stt_of(spark, d)
    published = stt.select("session_id", "turn_id", *(F.col(f"m.{t}").cast("double").alias(t) for t in findings.TIMINGS)).withColumn("e", F.col("turn_id").cast("long") % 50)
    published = published.withColumn("time_to_first_partial_ms", F.when(F.col("e") == 0, F.col("time_to_first_partial_ms") + 7).otherwise(F.col("time_to_first_partial_ms")))
    published = published.withColumn("endpoint_delay_ms", F.when(F.col("e") == 1, -1.0).otherwise(F.col("endpoint_delay_ms"))).withColumn("missing_final", F.when(F.col("e") == 3, 1 - F.col("missing_final")).otherwise(F.col("missing_final")))
    return findings.compared(published.filter("e <> 2"), findings.second_timings(stt), findings.TIMINGS)


_SAMPLES = "(select session_id, response_ms from heard where response_ms is not null)"


@query("G03_aggregate_check", NESTED_SQL + f"""select s.session_id, 'aggregate' as category, 'response_ms.p95' as field, p95 as expected, round(p95, 6) + 5 as actual from (select session_id, quantile_cont(response_ms, 0.95)::double as p95 from {_SAMPLES} r group by 1) s join (select session_id, min(e) as m from bound group by 1) b using (session_id) where m % 10 = 0
    union all select session_id, 'absence', 'response_ms.max', null, 1.0 from (select session_id from heard group by 1 having count(response_ms) = 0) z""")
def g03(spark, d):
    """Each call's stated block against its turns, of a copy in which some p95 are off and
    calls without a measured turn state a maximum."""
    turns = package_turns(spark, d)
    block = measures.linear_percentiles(turns, ["session_id"], "response_ms").select("session_id", F.col("n").alias("count"), "p50", "p90", "p95", F.col("least").alias("min"), F.col("greatest").alias("max"), "mean")
    first = turns.groupBy("session_id").agg(F.min(F.col("turn_id").cast("long")).alias("m"))
    stated = block.join(first, "session_id").withColumn("p95", F.when(F.col("m") % 10 == 0, F.col("p95") + 5).otherwise(F.col("p95"))).withColumn("max", F.when(F.col("count") == 0, 1).otherwise(F.col("max")))
    found = findings.aggregates(stated, turns, "response_ms")
    return found.withColumn("actual", F.round("actual", 6))


@query("G04_honesty", NESTED_SQL + """select session_id, turn_id, 'invariant' as category, 'reply_below_minimum' as field, null::double as expected, null::double as actual from heard where e % 40 = 0 union all select session_id, turn_id, 'invariant', 'negative_latency', null, null from heard where e % 40 = 1
    union all select session_id, turn_id, 'invariant', 'tool_failed_above_ops', null, null from heard where e % 40 = 2 union all select session_id, turn_id, 'invariant', 'continues_itself', null, null from heard where e % 40 = 3""")
def g04(spark, d):
    """The rules that every turn keeps, over a copy in which some break one each."""
    e = F.col("turn_id").cast("long") % 40
    turns = package_turns(spark, d).withColumn("response_ms", F.when(e == 0, 100).otherwise(F.col("response_ms"))).withColumn("stt_final_ms", F.when(e == 1, -5).otherwise(F.col("stt_final_ms")))
    turns = turns.withColumn("tool_failed", F.when(e == 2, F.col("tool_ops") + 1).otherwise(F.col("tool_failed"))).withColumn("continues_turn", F.when(e == 3, F.col("turn_id")).otherwise(F.col("continues_turn")))
    return findings.invariants(turns)
