"""Facts of calls from packages, and what replays say of their turns."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import scalars, spans
from callmetrics.operators import calls, challenger, evaluation, facts
from callmetrics.plans import package_queries, reports
from callmetrics.sources import nested, packages
from callmetrics.sources.shared import checkpointed
from tests.test_spans import turn

#: Small tables by a path that no other test reads, so that nothing of them is written yet.
FRESH = "/root/testdata/./sf0.001"
RECEIVED = "session_id string, timing struct<receipts:array<struct<kind:string,at_ms:bigint,audio_cursor_ms:bigint,text:string,result_audio_end_ms:bigint>>,commits:array<struct<at_ms:bigint,text:string,audio_start_ms:bigint,audio_end_ms:bigint>>>"


def lines(spark, rows):
    return spark.createDataFrame([(r["session_id"], json.dumps(r)) for r in rows], "package string, value string")


def manifests(spark, *rows):
    return packages.manifests_of(spark.read.schema(packages.MANIFEST).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])))


def test_turns_of_a_real_shaped_call(spark):
    """The usual pattern: reply after 1100 ms, first token after 200, first audio after 400."""
    rows = lines(spark, [*turn(0), *turn(3000, turn_id="t2")])
    ops, chunks = packages.operations_of(rows), packages.audio_chunks_of(rows)
    own = manifests(spark, {"session_id": "call-1", "agent_id": "support", "started_at": "2026-01-01T00:00:00+00:00", "duration_ms": 4200, "outcome": "completed", "capture_status": {"events_complete": True}})
    found = calls.turn_metrics(ops, chunks, own)
    assert [(r.turn_id, r.response_ms, r.llm_ttft_ms, r.tts_first_audio_ms, r.started_ms) for r in found.orderBy("turn_id").collect()] == [("t1", 1100, 200, 400, 1767225600000), ("t2", 1100, 200, 400, 1767225603000)]
    call = calls.call_metrics(found, own, ops).first()
    assert (call.turns, call.measured, call.max_response_ms, call.lag_turns, call.status, call.capture_incomplete, call.outcome) == (2, 2, 1100, 0, "ready", False, "completed")
    assert {r.scope: r.evidence for r in reports.alert_evidence(reports.alerts(found), found).collect()} == {"fleet": None, "support": None}


def test_windows_floors_splits_and_skips(spark):
    base = turn(0, "c", "a")
    late = turn(10_000, "c", "b")
    late[0]["response"] = {"continues_turn": "a", "reply_skipped": "callback_error", "words": [{"text": "x", "start_ms": 10_100, "end_ms": 11_800}]}  # audio 100 ms after the last word
    quiet = turn(20_000, "c", "d")
    del quiet[2]["milestones"]
    lost = turn(30_000, "c", "e")
    lost[0]["response"] = {"continues_turn": "gone"}
    chunk = {"kind": "audio_chunk", "session_id": "c", "track": "agent", "occurred_at_ms": 21_750.0, "duration_ms": 40.0}
    rows = lines(spark, [*base, *late, *quiet, *lost, chunk, {"event_id": "s", "session_id": "c", "type": "stt", "scope": "connection", "status": "cancelled"}])
    ops, own = packages.operations_of(rows), manifests(spark, {"session_id": "c", "agent_id": "x"}, {"session_id": "empty", "agent_id": "x"})
    found = calls.turn_metrics(ops, packages.audio_chunks_of(rows), own)
    got = {r.turn_id: r for r in found.collect()}
    assert {k: r.response_ms for k, r in got.items()} == {"a": 1100, "b": None, "d": 950, "e": 1100}
    assert (got["b"].status, got["b"].is_continuation, got["a"].has_continuation, got["a"].llm_split, got["e"].is_continuation) == ("error", True, True, True, False)
    by_call = {r.session_id: (r.turns, r.split_turns, r.status) for r in calls.call_metrics(found, own, ops).collect()}
    assert by_call == {"c": (3, 1, "ready"), "empty": (0, 0, "partial")}


def brute_stream(turns, receipts, commits):
    partials = [r for r in receipts if r[0] == "partial_transcript" and (r[3] or "").strip()]
    finals = [r for r in receipts if r[0] != "partial_transcript" and (r[3] or "").strip()]
    taken, out = set(), {}
    for name, start, end in sorted(turns, key=lambda t: (t[1], t[0])):
        pool = [(i, c[0], c[3]) for i, c in enumerate(commits) if start - 400 <= c[3] <= end + 1500] if commits else [(i, r[1], None) for i, r in enumerate(finals) if start <= r[1] <= end + 3000]
        claim = next((p for p in pool if p[0] not in taken), None)
        if claim:
            taken.add(claim[0])
        upper = claim[1] if claim else end + 2000
        first, previous = None, ""
        for r in partials:
            if start <= r[1] <= upper and r[3].strip() != previous:
                first = r[1]
                break
            previous = r[3].strip()
        inside = [r for r in partials if start <= r[1] <= upper]
        after = [r[1] for r in partials + finals if end <= r[1] <= upper]
        lag = round(sum(r[2] - r[4] for r in inside) / len(inside)) if inside else None
        out[name] = (first, claim and claim[1], len(inside), lag, min(after) - end if after else None, claim is None)
    return out


def test_replays_by_brute_force(spark):
    rng = random.Random(4)
    windows, runs, want = [], [], {}
    for s in range(12):
        turns, at = [], 0
        for i in range(8):
            at += rng.randint(100, 4000)
            turns.append((f"{s}-{i}", at, at + rng.randint(200, 1500)))
        receipts = sorted(((rng.choice(["partial_transcript", "partial_transcript", "committed_transcript"]), t, t, rng.choice(["a", "b", " "]), t - rng.randint(0, 300)) for t in rng.sample(range(25_000), 60)), key=lambda r: r[1])
        commits = sorted((t + 150, "x", t - 500, t) for t in rng.sample(range(25_000), 9)) if s % 2 else []
        windows += [(str(s), *t, t[1], True) for t in turns] + [(str(s), f"{s}-none", None, None, None, True)]
        runs.append((str(s), (receipts, commits)))
        want |= brute_stream(turns, receipts, commits)
    found = challenger.stream_latency(spark.createDataFrame(windows, "session_id string, turn_id string, start_ms long, end_ms long, onset_ms long, onset_reliable boolean"), spark.createDataFrame(runs, RECEIVED)).collect()
    got = {r.turn_id: (r.first_partial_at_ms, r.final_at_ms, r.partial_count, r.streaming_cursor_lag_ms, r.post_end_delay_ms, r.missing_final) for r in found if r.available}
    assert got == want and sum(r.reason == "no_speech_window" for r in found) == 12


def test_bodies_whole_cut_and_wrapped(spark):
    cut = '{"model": "m", "messages": [{"role": "user", "content": "use {x} and \\"y\\"]"}, {"role": "tool", "tool_call_id": "7", "content": [{"text": "p"}, {"text": "q"}]}, {"role": "assistant", "content": "hel'
    assert spans.messages_in(cut) == [{"role": "user", "content": 'use {x} and "y"]', "tool_call_id": None}, {"role": "tool", "content": "p\nq", "tool_call_id": "7"}]
    assert spans.messages_in('{"model": 1}') == spans.messages_in("") == []
    wrapped = json.dumps({"_truncated": True, "_preview": '{"choices": [', "_original_bytes": 99})
    rows = [(wrapped,), (None,), ("plain words",), ('{"choices": [{"message": {"content": "a", "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]}}]}',)]
    got = spark.createDataFrame(rows, "body string").select(spans.decoded_completion(spans.F.col("body")).alias("c"), spans.unwrapped_body(spans.F.col("body")).alias("u")).collect()
    assert [(r.c.text, r.c.truncated) for r in got] == [("", True), ("", False), ("plain words", False), ("a", False)]
    assert got[0].u.original_bytes == 99 and [tuple(x) for x in got[3].c.tool_calls] == [("f", "{}")]


def test_secrets_at_any_depth(spark):
    body = json.dumps({"api_key": "k", "list": [{"note": "Bearer abcdefghijklmnop"}], "body": json.dumps({"Password": "p", "n": 5}), "cookie": " "})
    r = spark.createDataFrame([(body,), (None,), ("key AKIAABCDEFGHIJKL12",)], "b string").select(scalars.redact_json("b").alias("r")).collect()
    assert json.loads(r[0].r.text) == {"api_key": "[redacted]", "list": [{"note": "[redacted]"}], "body": '{"Password":"[redacted]","n":5}', "cookie": " "}
    assert (r[0].r.secret_keys, r[0].r.secret_values, r[1].r.text, r[2].r.secret_values) == (2, 1, None, 1)


def test_short_cut_replies_give_way(spark):
    rows = [("s", "assistant", t, i, 0) for i, t in enumerate(["ok", "ok let me", "ok let me see", "yes", "yesterday", "no"])]
    got = evaluation.transcript(spark.createDataFrame(rows, "session_id string, role string, text string, op_id int, position int"))
    assert sorted(r.text for r in got.collect()) == ["no", "ok let me see", "yesterday"]


def test_calls_are_flat_facts_too(spark):
    """Rows of packages serve the measures that rows of flat operations do."""
    rows = lines(spark, turn(0))
    own = manifests(spark, {"session_id": "call-1", "agent_id": "x", "started_at": "2026-01-01T00:00:00Z"})
    turns = calls.turn_metrics(packages.operations_of(rows), packages.audio_chunks_of(rows), own)
    assert facts.call_facts(turns).first().measured == 1
    parts = reports.summary(turns, reports.Filters(1767225600000, 1767229200000))
    assert parts["latency"].first().p50 == pytest.approx(1100) and {r.stage: r.ops for r in parts["stages"].collect()} == {"stt": 1, "llm": 1, "tts": 1, "tool": 0}


def counting(spark, df, name):
    """``df`` and a count of how often a row of it was computed."""
    seen = spark.sparkContext.accumulator(0)

    def note(value):
        seen.add(1)
        return value

    return df.withColumn(name, F.udf(note, "string").asNondeterministic()(F.col(name))), seen


def test_lines_are_read_once_and_spans_twice(spark):
    told = [*turn(0), *turn(3000, turn_id="t2"), {"kind": "audio_chunk", "session_id": "call-1", "track": "agent", "occurred_at_ms": 1950, "duration_ms": 300.5, "operation_id": "t1-tts"}]
    rows, seen = counting(spark, lines(spark, told), "value")
    ops = packages.operations_of(rows)
    assert ops.count() == 6 and seen.value == len(told)
    chunks = packages.audio_chunks_of(lines(spark, told))
    ops, seen = counting(spark, ops, "status")  # recognitions and model calls, and syntheses apart
    assert calls.grouped_turns(ops, chunks).count() == 2 and seen.value <= 12


def test_chunks_spelt_with_escapes_are_chunks(spark):
    rows = spark.createDataFrame([("c", '{"kind": "audio\\u005fchunk", "session_id": "c", "duration_ms": 1.5}'), ("c", '{"event_id": "a", "session_id": "c", "type": "stt", "duration_ms": "long"}'), ("d", "[1"), ("d", '{"event_id": "b", "session_id": "d", "type": "stt"}')], "package string, value string")
    parsed = packages.parsed_lines(rows)
    assert [r.duration_ms for r in packages.audio_chunks_in(parsed).collect()] == [1.5]
    found = packages.operations_in(parsed, packages.rejected_in(parsed)).collect()  # a value of another kind rejects nothing
    assert [(r.event_id, r.duration_ms) for r in found] == [("a", None)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_recognitions_run_compiled_and_names_are_read_once(spark, monkeypatch):
    ops = packages.operations_of(lines(spark, [*turn(0)]))
    chunks = packages.audio_chunks_of(lines(spark, [*turn(0)]))
    assert "transform(array(" not in plan_of(calls.timed(ops))  # which is interpreted
    made = []
    monkeypatch.setattr(calls, "checkpointed", lambda df: made.append(df) or checkpointed(df))
    calls.grouped_turns(ops, chunks)
    branches = 2  # syntheses, which meet their chunks, and all other spans
    assert plan_of(made[0]).count("[^a-z0-9]+") <= 2 * branches


def test_only_turns_that_fold_are_grouped(spark):
    told = [("s", "a", None, 1), ("s", "b", "a", 1), ("s", "c", "b", 0), ("s", "x", "gone", 1), ("s", "y", "y", 1), ("t", "a", None, 1)]
    turns = spark.createDataFrame([(*r[:3], r[3], 1, 0, 0) for r in told], "session_id string, turn_id string, continues_turn string, stt_ops int, llm_ops int, tts_ops int, tool_ops int")
    found = facts.split_columns(turns)
    assert "Window" not in plan_of(found)
    got = {(r.session_id, r.turn_id): (r.root, r.is_continuation, r.has_continuation, r.stt_split, r.llm_split, r.tts_split) for r in found.collect()}
    alone = {k: (k[1], False, False, False, False, False) for k in (("s", "x"), ("s", "y"), ("t", "a"))}
    assert got == alone | {("s", "a"): ("a", False, True, True, True, False), ("s", "b"): ("a", True, False, False, False, False), ("s", "c"): ("a", True, False, False, False, False)}


def test_only_lines_of_that_kind_are_parsed_as_chunks(spark):
    told = [*turn(0), {"kind": "audio_chunk", "session_id": "call-1", "duration_ms": 1.5}]  # the synthesis names a milestone audio_chunk
    parsed = packages.parsed_lines(lines(spark, told))
    assert "contains(value" not in plan_of(parsed).lower()
    assert [r.duration_ms for r in packages.audio_chunks_in(parsed).collect()] == [1.5] and packages.operations_in(parsed, packages.rejected_in(parsed)).count() == len(told) - 1


def longest_method(spark, df):
    code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_turns_are_measured_by_code_that_the_jvm_optimises(spark, monkeypatch):
    """The JVM compiles no method of more than 8,000 bytes."""
    ops = packages.operations_of(lines(spark, turn(0)))
    chunks = packages.audio_chunks_of(lines(spark, turn(0)))
    made = []
    monkeypatch.setattr(calls, "checkpointed", lambda df: made.append(df) or checkpointed(df))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its code
    try:
        calls.grouped_turns(ops, chunks)
        assert longest_method(spark, made[0]) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_turns_are_written_once_and_joined_once(spark, monkeypatch):
    rows = lines(spark, turn(0))
    ops, chunks, own = packages.operations_of(rows), packages.audio_chunks_of(rows), manifests(spark, {"session_id": "call-1", "agent_id": "x"})
    made = []
    monkeypatch.setattr(calls, "checkpointed", lambda df: made.append(df) or checkpointed(df))
    found = calls.turn_metrics(ops, chunks, own)
    assert len(made) == 1 and found.count() == 1


def test_chunks_of_one_instant_meet_a_silent_turn_once(spark, monkeypatch):
    quiet = turn(20_000, "c", "d")
    del quiet[2]["milestones"]
    chunk = {"kind": "audio_chunk", "session_id": "c", "track": "agent", "duration_ms": 40.0}
    rows = lines(spark, [*quiet, *({**chunk, "occurred_at_ms": 21_750.25 + i / 1000} for i in range(200)), {**chunk, "occurred_at_ms": 21_760.0}])
    met = []
    whole = calls.overlaps
    monkeypatch.setattr(calls, "overlaps", lambda *a: met.append(whole(*a)) or met[0])
    found = calls.grouped_turns(packages.operations_of(rows), packages.audio_chunks_of(rows)).first()
    assert met[0].count() == 2 and found.response_ms == round(21_750.25 - 20_800)


def test_spans_are_measured_as_their_lines_are_parsed(spark):
    """Facts of lines that were measured before they were written are those of whole spans:
    with a rejected package, a connection, chunks and a turn that has no reply of its own."""
    quiet = turn(20_000, "c", "d")
    del quiet[2]["milestones"]
    tool = {**turn(0, "c", "a")[1], "event_id": "x-tool", "type": "tool", "status": "error", "error": {"name": "TimeoutError", "message": "late"}, "request": {"name": "find"}}
    chunk = {"kind": "audio_chunk", "session_id": "c", "track": "agent", "occurred_at_ms": 21_750.0, "duration_ms": 40.0}
    told = [*turn(0, "c", "a"), tool, *quiet, chunk, {"event_id": "s", "session_id": "c", "type": "stt", "scope": "connection", "status": "error"}, *turn(0, "bad", "a")]
    rows = lines(spark, told).union(spark.createDataFrame([("bad", "{"), ("c", json.dumps({"event_id": "o", "session_id": "other", "type": "llm"}))], "package string, value string"))
    opened = packages.opened_lines(rows).select("package", "text", "whole", "op.*")
    written = checkpointed(calls.measured_spans(opened, "package", packages.chunk_of(F.col("text")).alias("chunk"), "whole"))
    measured = written.filter("type is not null").join(packages.rejected_in(written), "package", "left_anti")
    ops, chunks, own = packages.operations_of(rows), packages.audio_chunks_of(rows), manifests(spark, {"session_id": "c", "agent_id": "x", "started_at": "2026-01-01T00:00:00+00:00"}, {"session_id": "bad", "agent_id": "y"})
    wide, narrow = calls.turn_metrics(ops, chunks, own), calls.measured_turns(measured, packages.audio_chunks_in(written), own)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
    assert same(wide, narrow) and {r.turn_id: r.response_ms for r in narrow.collect()} == {"a": 1100, "d": 950}
    assert same(calls.call_metrics(wide, own, ops), calls.call_metrics(narrow, own, measured)) and same(calls.tool_metrics(ops), calls.tool_metrics(measured)) and same(calls.failure_metrics(ops, own), calls.failure_metrics(measured, own))


def test_reports_of_packages_write_no_captured_payload(spark):
    """What reports are made of is parsed once and measured in the same pass, by code that the
    JVM optimises, and is written without milestones, words, samples and texts."""
    before = set(nested._STORED)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its code
    try:
        made = nested._measured(spark, FRESH)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 3 and longest_method(spark, made) < 8000  # as a span, as a chunk, and what did not fit
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    package_queries.calls_of(spark, FRESH).count()
    assert {k[2] for k in set(nested._STORED) - before} == {"measured", "rejected", "turns", "manifests"}
    assert not {"milestones", "samples", "response", "words"} & set(made.columns)
