"""Calls and exchanges count once; a range from tiers says what it says from turns."""

import pytest
from pyspark.sql import functions as F

from callmetrics.operators import facts, rollups
from callmetrics.plans import reports
from callmetrics.plans.dashboard_queries import _flat, _package

SMALL = "/root/testdata/sf0.001"
HOUR = 3_600_000
RANGE = (1_704_000_000_000 // 86_400_000 * 86_400_000, 1_707_000_000_000 // 86_400_000 * 86_400_000)

TURN = (
    "session_id string, turn_id string, agent_id string, started_ms long, ended_ms long, duration_ms long, status string, response_ms long, stt_ops long, llm_ops long, tts_ops long, tool_ops long, stt_failed long, llm_failed long, "
    "tts_failed long, tool_failed long, tts_interrupted long, stt_provider string, llm_provider string, tts_provider string, continues_turn string"
)


def turn(session, name, at, response=None, continues=None, failed=0, agent="a"):
    return (session, name, agent, at, at + 1000, 1000, "ok", response, 1, 1, 0, 0, 0, failed, 0, 0, 0, "p", None, None, continues)


@pytest.fixture(scope="module")
def straddling(spark):
    """One call: a turn in hour 100, another in hour 101 and a third that continues it there."""
    rows = [turn("s", "t1", 100 * HOUR, 900), turn("s", "t2", 101 * HOUR, 3500, failed=1), turn("s", "t3", 101 * HOUR + 5000, 400, "t2", failed=1)]
    return facts.split_columns(spark.createDataFrame(rows, TURN))


def test_calls_and_exchanges_count_once(spark, straddling):
    calls = facts.call_facts(straddling)
    rolled = {(r.bucket_ms // HOUR, r.agent_id): r for r in rollups.interval_rollup(straddling, calls).collect()}
    assert {k: (r.turns, r.split_turns, r.measured, r.calls, r.llm_calls_impacted, r.llm_failed) for k, r in rolled.items() if k[1] == "a"} == {(100, "a"): (1, 0, 1, 1, 0, 0), (101, "a"): (1, 1, 2, 0, 1, 2)}
    assert rolled[101, "__all__"].stt_split_turns == 1
    total = rollups.range_counters(rollups.interval_rollup(straddling, calls), "agent_id").filter("agent_id = 'a'").first()
    assert (total.turns, total.calls, total.llm_calls_impacted, total.lag_turns) == (2, 1, 1, 1)
    parts = reports.summary(straddling, reports.Filters(100 * HOUR, 102 * HOUR))
    assert parts["overview"].first().turns == 2 and parts["accuracy"].first().exchanges == 2
    assert sum(r.turns for r in parts["trend"].collect()) == 2 and sum(r.calls for r in parts["trend"].collect()) == 1
    state = {(r.scope, r.figure): r.weight for r in reports.alert_state(straddling).filter("value is null").collect()}
    assert state["fleet", "turns"] == 2 and state["fleet", "calls"] == 1


def test_a_call_over_two_hours_is_no_two_calls_in_a_range(spark):
    rows = [turn(f"s{i}", f"t{i}-{h}", (100 + h) * HOUR, failed=1) for i in range(3000) for h in range(3)]
    turns = spark.createDataFrame(rows, TURN)
    hours = rollups.interval_rollup(turns, facts.call_facts(turns))
    total = rollups.range_counters(hours, "agent_id").filter("agent_id = 'a'").first()
    assert total.calls == 3000 and total.llm_failed == 9000
    assert abs(total.llm_calls_impacted - 3000) <= 60  # sums of hours would say 9,000
    tools = spark.createDataFrame([(r[0], r[1], f"o{i}", "find", 5, i % 2 == 0, False) for i, r in enumerate(rows)], "session_id string, turn_id string, op_id string, tool_name string, duration_ms long, failed boolean, timed_out boolean")
    faults = turns.select("session_id", "turn_id", F.lit("o").alias("op_id"), F.lit("llm").alias("stage"), "agent_id", "started_ms", F.lit("llm:X").alias("fingerprint"))
    tiers = rollups.build(turns, facts.call_facts(turns), tools, faults).between(100 * HOUR, 103 * HOUR)
    found = rollups.range_tools(tiers).first()
    assert (found.invocations, found.failed) == (9000, 4500) and abs(found.calls - 3000) <= 60
    fault = rollups.range_failures(tiers.failures).first()
    assert fault.n == 9000 and abs(fault.calls - 3000) <= 60


def test_every_part_from_tiers_is_within_one_percent(spark):
    turns, calls, tools, failures = (df.cache() for df in _package(spark, SMALL))
    tiers = rollups.build(turns, calls, tools, failures)
    for agent in (None, "agent-2"):
        filters = reports.Filters(*RANGE, agent_id=agent)
        exact = reports.summary(turns, filters, calls, tools, failures, limit=1 << 40)
        rolled = reports.summary(turns, filters, calls, tools, failures, tiers, limit=0)
        assert (exact["accuracy"].first().way, rolled["accuracy"].first().way) == ("exact", "rollup")
        assert set(exact) == set(rolled)
        keys = {"panels": ["stage", "metric"], "stages": ["stage"], "extras": ["key"], "trend": ["bucket_ms"], "tools": ["tool_name"], "latency": [], "counters": [], "overview": []}
        if agent is None:
            keys["failures"] = ["fingerprint"]
        for part, by in keys.items():
            rows = lambda df: {tuple(r[k] for k in by): r.asDict(True) for r in df.collect()}  # noqa: B023, E731
            left, right = rows(exact[part]), rows(rolled[part])
            assert left.keys() == right.keys() and left, part
            for k in left:
                for name in set(left[k]) & set(right[k]):
                    a, b = left[k][name], right[k][name]
                    if isinstance(a, float | int) and not isinstance(a, bool):
                        assert abs(a - b) <= 0.011 * abs(a) + 0.51, (part, k, name, a, b)


def test_flat_facts_have_a_whole_dashboard(spark):
    turns, calls, tools, failures = _flat(spark, SMALL)
    parts = reports.summary(turns, reports.Filters(*RANGE), calls, tools, failures)
    assert {r.reason for r in parts["panels"].collect()} == {"stage_absent", "milestone_not_captured"} or {r.reason for r in parts["panels"].collect()} == {"milestone_not_captured"}
    assert parts["overview"].first().calls > 0 and parts["tools"].count() > 0


def test_a_filter_beyond_the_limit_is_refused_and_claims_nothing(spark):
    turns, calls, tools, failures = _package(spark, SMALL)
    parts = reports.summary(turns, reports.Filters(*RANGE, environment="staging"), calls, tools, failures, limit=0)
    assert parts["accuracy"].first().reason == "range_too_large_for_filter"
    assert "panels" not in parts and "tools" not in parts and parts["overview"].first().calls > 0
    with pytest.raises(ValueError, match="need calls"):
        reports.Filters(*RANGE, environment="staging").turns(turns)


def test_change_needs_samples_on_both_sides(spark):
    def delta(n_before, n_now):
        rows = [turn(f"b{i}", f"b{i}", 50 * HOUR, 1000) for i in range(n_before)] + [turn(f"n{i}", f"n{i}", 100 * HOUR, 1500) for i in range(n_now)]
        return reports.summary(spark.createDataFrame(rows, TURN), reports.Filters(100 * HOUR, 151 * HOUR))["latency"].first().change

    assert delta(30, 30).asDict() == {"available": True, "reason": None, "previous": 1000.0, "current": 1500.0, "absolute": 500.0, "relative": 0.5}
    assert delta(29, 30).reason == "below_minimum_sample"
    assert delta(0, 30).reason == "no_previous_period"


def test_triage_ranks_broken_blind_slow_and_leaves_probes_out(spark):
    long = 60_000
    make = lambda name, **k: ({"session_id": name, "agent_id": "a", "started_ms": 1, "duration_ms": long, "turns": 4, "failed_ops": 0, "lag_turns": 0, "measured": 3, "max_response_ms": 900, "interrupted": 0, "missing_final_turns": 0, "capture_incomplete": False, "llm_failed": 0} | k)
    rows = [
        make("fine"), make("slow", lag_turns=1, max_response_ms=11_000), make("failed", failed_ops=2, llm_failed=2), make("no final", missing_final_turns=1), make("capture", capture_incomplete=True), make("blind", measured=0, max_response_ms=None),
        make("probe", measured=0, duration_ms=1000, max_response_ms=None), make("silent", measured=0, turns=0, max_response_ms=None),
    ]
    kinds = "session_id string, agent_id string, started_ms long, duration_ms long, turns long, failed_ops long, lag_turns long, measured long, max_response_ms long, interrupted long, missing_final_turns long, capture_incomplete boolean, llm_failed long"
    calls = spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in rows], kinds)
    got = [(r.session_id, r.severity, [x.kind for x in r.reasons], r.total) for r in reports.attention(calls).collect()]
    assert [g[0] for g in got] == ["failed", "capture", "no final", "blind", "slow"] and {g[3] for g in got} == {5}
    assert [g[1] for g in got] == [3, 2, 2, 2, 1]
    assert got[0][2] == ["failure"] and got[3][2] == ["unmeasured"]
    assert reports.attention(calls, limit=2).first().reasons[0].label == "2 LLM failures"
