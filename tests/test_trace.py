"""Traces by brute force, findings on seeded faults, and reports of challengers."""

import random

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import scalars, spans, text
from callmetrics.operators import evaluation, findings, intervals, onboarding, trace
from callmetrics.plans import registry, scalar_queries  # noqa: F401
from callmetrics.plans.package_queries import stt_of
from callmetrics.sources.packages import OPERATION

SMALL = "/root/testdata/sf0.001"


def brute_trace(rows, known):
    """By span: section, parent, encloser, depth; each span looks at all others of its call."""
    socket = lambda r: r["scope"] == "connection" or (r["turn_id"] is None and r["transport"] == "websocket")
    attempt = lambda r: r["type"] == "llm" and not r["tokens"]
    own = {r["event_id"]: r for r in rows}
    inside, served = {}, {}
    for r in rows:
        if socket(r):
            continue
        around = [o for o in rows if not socket(o) and o["session_id"] == r["session_id"] and o["s"] <= r["s"] and o["e"] >= r["e"] and (o["s"] < r["s"] or o["e"] > r["e"] or o["event_id"] < r["event_id"])]
        inside[r["event_id"]] = max(around, key=lambda o: (o["s"], -o["e"], o["event_id"]))["event_id"] if around else None
        if attempt(r):
            hosts = [o for o in rows if o["type"] == "llm" and not socket(o) and not attempt(o) and (o["session_id"], o["turn_id"]) == (r["session_id"], r["turn_id"]) and r["s"] >= o["s"] - 500 and r["e"] <= o["e"] + 500]
            served[r["event_id"]] = max(hosts, key=lambda o: (o["s"], o["event_id"]))["event_id"] if hosts else None
    out = {}
    for name, r in own.items():
        depth, up = 0, inside.get(name)
        while up is not None:
            depth, up = depth + 1, inside[up]
        section = "sockets" if socket(r) else f"turn:{r['turn_id']}" if (r["session_id"], r["turn_id"]) in known else "loose"
        out[name] = (section, served.get(name), inside.get(name), depth)
    return out


def test_trace_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        a = rng.randrange(0, 6000)
        socket = rng.random() < 0.08
        rows.append({
            "event_id": f"x{i:03d}", "session_id": f"s{i % 4}", "turn_id": None if socket or rng.random() < 0.1 else f"t{rng.randrange(5)}", "scope": "connection" if socket and rng.random() < 0.5 else "turn", "transport": "websocket" if socket else "http",
            "type": rng.choice(("stt", "llm", "llm", "tts", "tool")), "s": a, "e": a + rng.choice((0, 10, 100, 2000, 6000)), "tokens": rng.random() < 0.5,
        })
    rows += [dict(rows[0], event_id="twin1"), dict(rows[0], event_id="twin2"), dict(rows[0], event_id="no_end", e=rows[0]["s"])]
    ops = spark.createDataFrame([(r["event_id"], r["session_id"], r["turn_id"], r["scope"], r["transport"], r["type"], r["s"], r["e"], 5 if r["tokens"] else None) for r in rows], "event_id string, session_id string, turn_id string, scope string, transport string, type string, started_at_ms long, ended_at_ms long, n long")
    ops = ops.withColumn("response", F.struct(F.col("n").alias("total_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.lit(None).cast("double").alias("ttft_ms"), F.lit(None).cast("int").alias("status"))).withColumn("request", F.struct(F.lit(None).cast("string").alias("body")))
    known = {("s0", "t0"), ("s1", "t1"), ("s2", "t2"), ("s0", "t3")}
    got = trace.session_trace(ops, spark.createDataFrame(sorted(known), "session_id string, turn_id string")).collect()
    assert len(got) == len(rows)
    want = brute_trace(rows, known)
    assert {r.event_id: (r.section, r.parent_id, r.enclosing_id, r.depth) for r in got} == want
    places = {}
    for r in got:
        places.setdefault((r.session_id, r.section, r.parent_id), []).append(r.place)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in places.values())


def test_a_deep_chain_is_climbed_in_few_rounds(spark):
    rows = [("s", f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(300)]
    got = trace.depths(spark.createDataFrame(rows, "session_id string, event_id string, up string")).collect()
    assert {r.event_id: r.depth for r in got} == {f"n{i:04d}": i for i in range(300)}


def test_one_finding_a_seeded_fault_and_none_else(spark):
    stt = stt_of(spark, SMALL)
    clean = stt.select("session_id", "turn_id", *(F.col(f"m.{t}").cast("double").alias(t) for t in findings.TIMINGS))
    second = findings.second_timings(stt)
    assert findings.compared(clean, second, findings.TIMINGS).count() == 0
    near = clean.withColumn("speech_end_ms", F.col("speech_end_ms") + 0.5)
    assert findings.compared(near, second, findings.TIMINGS).count() == 0  # within the tolerance
    turn = clean.orderBy("turn_id").first().turn_id
    at = F.col("turn_id") == turn
    for field in findings.TIMINGS:
        found = findings.compared(clean.withColumn(field, F.when(at, F.coalesce(F.col(field), F.lit(0.0)) + 3).otherwise(F.col(field))), second, findings.TIMINGS).collect()
        assert [(f.turn_id, f.field, f.category in ("evidence", "absence")) for f in found] == [(turn, field, True)]
    lost = findings.compared(clean.filter(~at), second, findings.TIMINGS).collect()
    assert [(f.category, f.field, f.expected, f.actual) for f in lost] == [("invariant", "turn", 1.0, None)]


@pytest.mark.parametrize("lacks", [{"recorded": False}, {"ran": False}, {"ambiguous": True}])
def test_pairs_that_cannot_be_scored_say_why(spark, lacks):
    want = {"recorded": "production_transcript_not_captured", "ran": "challenger_not_run", "ambiguous": "challenger_mapping_ambiguous"}[next(iter(lacks))]
    row = spark.createDataFrame([("a b c", "a x c")], "p string, c string")
    got = row.select(text.scored_pair(F.col("p"), F.col("c"), **{k: F.lit(v) for k, v in lacks.items()}).alias("s")).first().s
    assert (got.status, got.wer, got.errors, got.band) == (want, None, 0, "unavailable")


def test_worst_turns_are_those_with_the_highest_error_rate(spark):
    rows = [("s", f"t{i}", "evaluated", i / 10) for i in range(8)] + [("s", "gone", "possible_missed_speech", 1.0), ("s", "none", "challenger_empty", None), ("z", "only", "challenger_not_run", None)]
    got = evaluation.worst_turns(spark.createDataFrame(rows, "session_id string, turn_id string, status string, wer double"), ["session_id"]).orderBy("place").collect()
    assert [(r.turn_id, r.place) for r in got] == [("gone", 1), ("t7", 2), ("t6", 3), ("t5", 4), ("t4", 5)]


def test_challenger_latency_of_replayed_turns(spark):
    kinds = "session_id string, turn_id string, available boolean, time_to_first_partial_ms long, endpoint_delay_ms long, post_end_delay_ms long, streaming_cursor_lag_ms long, partial_count long, missing_final boolean"
    rows = [("s", "a", True, 100, 300, 20, 5, 2, False), ("s", "b", True, 200, None, 40, 5, 4, True), ("s", "c", False, None, None, None, None, None, None)]
    got = {r.metric: r for r in evaluation.challenger_latency(spark.createDataFrame(rows, kinds)).collect()}
    assert (got["time_to_first_partial_ms"].p50, got["endpoint_delay_ms"].n, got["partial_count"].greatest) == (150.0, 1, 4.0)
    assert {(r.measured_turns, r.missing_final_count) for r in got.values()} == {(2, 1)}


def test_steps_are_verified_only_by_what_was_seen(spark):
    kinds = "session_id string, created_ms long, status string, sdk_version string"
    none = spark.createDataFrame([], "session_id string")

    def states(rows, ops=none, keys=0):
        state = onboarding.ingest_state(spark.createDataFrame(rows, kinds).withColumn("k", F.lit(1)), ops, ["k"])
        return {r.step: (r.state, r.waiting_for) for r in onboarding.steps(state, ["k"], keys).collect()}

    assert states([("a", 1, "uploading", None)])["capture"] == ("waiting", "upload_never_finished")
    silent = states([("a", 1, "ready", None), ("b", 2, "uploading", "1.0")], keys=1)
    assert silent["capture"] == ("waiting", "no_operations_recorded") and silent["install"][0] == silent["api-key"][0] == "verified"
    assert states([("a", 1, "ready", None)], spark.createDataFrame([("a",)], "session_id string"))["capture"] == ("verified", None)


def test_credentials_at_any_depth_and_in_documents_within_texts():
    key = "ghp_" + "a" * 24
    inner = '{"password": "p", "note": "use %s", "more": "[\\"%s\\", 1]"}' % (key, key)
    body = '{"list": [%s, {"api_key": " "}], "api_key": "t", "said": "é \\\\ ok"}' % __import__("json").dumps(inner)
    text_, keys, shapes = scalars.scrubbed(body)
    assert key not in text_ and (keys, shapes) == (2, 2)
    assert text_.endswith('"said":"é \\\\ ok"}') and "\\\\\\\"[redacted]" in text_
    assert scalars.scrubbed(f"plain {key}") == ("plain [redacted]", 0, 1) and scalars.scrubbed('{"cut": "') == ('{"cut": "', 0, 0)


def test_streamed_events_of_one_document_or_one_a_line():
    one = 'data: {"choices":[{"delta":\ndata: {"content":"hi"}}]}\n\ndata: [DONE]\n'
    each = 'data: {"choices":[{"index":0,"delta":{"content":"a"}}]}\r\ndata: {"choices":[{"index":0,"delta":{"content":"b"},"finish_reason":"stop"}],"usage":{"total_tokens":3}}\r\n\r\n'
    assert spans.completion(one)["text"] == "hi"
    assert (spans.completion(each)["text"], spans.completion(each)["finish_reason"], spans.completion(each)["total_tokens"]) == ("ab", "stop", 3)
    assert OPERATION and spans.completion('{"choices": [{')["truncated"] and spans.completion("sorry")["text"] == "sorry"


def test_spans_without_length_are_enclosed_at_either_end_too(spark):
    spans = lambda rows, p: spark.createDataFrame(rows, f"session_id string, {p}_id long, {p}_from long, {p}_to long")
    inner = spans([("s", 1, 500, 500), ("s", 2, 2500, 2500), ("s", 3, 2501, 2501), ("s", 4, 499, 600), ("s", 5, 1000, 2500), ("t", 6, 1500, 1500)], "l")
    found = intervals.tightest_enclosing(inner, spans([("s", 7, 1000, 2000), ("s", 8, 900, 1100)], "r"))
    assert {r.l_id: r.r_id for r in found.collect()} == {1: 7, 2: 7, 4: 8, 5: 7}


def test_instant_tools_have_their_model_call(spark, tmp_path):
    spark.sql("select * from values (1L, timestamp_ntz '2024-01-01 00:00:00', 5L, 'view', 1.0D, '{\"k\": 1}'), (2L, timestamp_ntz '2024-01-01 00:00:01', 5L, 'signup', 0.0D, '{\"k\": 1}') as e(event_id, ts, user_id, event_type, value, props)").write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.l_id, r.r_id) for r in registry.QUERIES["J08_tightest_enclosing"](spark, str(tmp_path)).collect()] == [(2, 1)]
