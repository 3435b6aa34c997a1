"""Nested span rules on small packages."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import spans
from callmetrics.functions.scalars import bucket_size_ms, canonical_provider
from callmetrics.operators import calls, challenger, facts
from callmetrics.plans.reports import Filters, route
from callmetrics.sources import packages


def turn(base, session="call-1", turn_id="t1"):
    at = lambda x: {"occurred_at_ms": base + x, "count": 1}
    common = {"session_id": session, "turn_id": turn_id, "scope": "turn", "status": "ok"}
    return [
        common | {"event_id": f"{turn_id}-stt", "type": "stt", "started_at_ms": base, "ended_at_ms": base + 900, "duration_ms": 900, "milestones": {"speech_started": at(0), "first_partial": at(300), "speech_ended": at(800), "final_transcript": at(900)}, "response": {"transcript": "hi", "words": [{"text": "hi", "start_ms": base + 100, "end_ms": base + 800}]}},
        common | {"event_id": f"{turn_id}-llm", "type": "llm", "started_at_ms": base + 900, "ended_at_ms": base + 1500, "duration_ms": 600, "milestones": {"first_token": at(1100)}},
        common | {"event_id": f"{turn_id}-tts", "type": "tts", "started_at_ms": base + 1500, "ended_at_ms": base + 2200, "duration_ms": 700, "milestones": {"audio_chunk": at(1900)}},
    ]


@pytest.fixture(scope="module")
def operations(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("packages")
    good, bad = root / "call-1", root / "call-2"
    good.mkdir(), bad.mkdir()
    chunk = {"kind": "audio_chunk", "session_id": "call-1", "track": "agent", "occurred_at_ms": 1950, "duration_ms": 300, "operation_id": "t1-tts"}
    other = turn(0)[0] | {"session_id": "elsewhere"}
    (good / "events.jsonl").write_text("\n".join(json.dumps(x) for x in [*turn(0), *turn(3000, turn_id="t2"), chunk, other]))
    (bad / "events.jsonl").write_text(json.dumps(turn(0, "call-2")[0]) + "\n{broken\n")
    return root


def test_operations_keep_own_spans_and_reject_broken_packages(spark, operations):
    found = packages.read_operations(spark, f"{operations}/*/events.jsonl")
    assert {r.event_id for r in found.collect()} == {f"t{i}-{s}" for i in (1, 2) for s in ("stt", "llm", "tts")}
    assert [(r.package, r.bad_lines) for r in packages.rejected_packages(packages.read_lines(spark, f"{operations}/*/events.jsonl")).collect()] == [("call-2", 1)]


def test_audio_chunks_and_presentation_windows(spark, operations):
    path = f"{operations}/*/events.jsonl"
    chunks = packages.read_audio_chunks(spark, path)
    assert chunks.count() == 1
    shown = calls.presentation_windows(packages.read_operations(spark, path), chunks).filter("type = 'tts'")
    assert {(r.event_id, r.shown and tuple(r.shown)) for r in shown.collect()} == {("t1-tts", (1950, 2250, "attributed_audio_chunks")), ("t2-tts", None)}


def test_turn_latency_is_measured_or_null_with_a_reason(spark, operations):
    ops = packages.read_operations(spark, f"{operations}/*/events.jsonl").filter("type = 'stt' and turn_id = 't1'")
    r = ops.withColumn("window", spans.speech_window()).withColumn("profile", spans.capture_profile()).withColumn("m", spans.production_turn_latency()).first()
    assert (r.window.start_ms, r.window.end_ms, r.window.from_word_timestamps) == (100, 800, True)
    assert (r.m.time_to_first_partial_ms, r.m.endpoint_delay_ms, r.m.final_from_last_word_ms) == (200, 100, 100)
    assert r.m.endpoint_measurable and r.m.endpoint_unmeasurable_reason is None


def one(spark, operation):
    return spark.read.schema(packages.OPERATION).json(spark.sparkContext.parallelize([json.dumps(operation)]))


def test_real_shaped_turn(spark):
    at = lambda x: {"occurred_at_ms": x}
    words = [{"text": "Okay.", "start_ms": 25218, "end_ms": 25938}, {"text": "Bengaluru.", "start_ms": 25938, "end_ms": 26738}]
    op = {"type": "stt", "started_at_ms": 14078, "ended_at_ms": 27592, "request": {"endpointing_ms": 300}, "response": {"words": words}, "milestones": {"speech_started": at(14078), "first_partial": at(25883), "speech_ended": at(27308), "final_transcript": at(27592)}}
    r = one(spark, op).withColumn("window", spans.speech_window()).withColumn("profile", spans.capture_profile()).withColumn("m", spans.production_turn_latency()).first()
    assert (r.window.start_ms, r.window.end_ms) == (25218, 26738)
    assert (r.m.time_to_first_partial_ms, r.m.endpoint_delay_ms, r.m.endpoint_position_error_ms, r.m.final_from_last_word_ms) == (665, 284, 570, 854)


def test_equal_instants_measure_nothing(spark):
    at = lambda x: {"occurred_at_ms": x}
    op = {"type": "stt", "started_at_ms": 0, "ended_at_ms": 900, "milestones": {"speech_ended": at(900), "final_transcript": at(900)}}
    r = one(spark, op).withColumn("window", spans.speech_window()).withColumn("profile", spans.capture_profile()).withColumn("m", spans.production_turn_latency()).first()
    assert r.m.endpoint_delay_ms is None and r.m.endpoint_unmeasurable_reason == "final_transcript_milestone_not_recorded"


def test_repeated_finals_extend_speech(spark):
    ms = {"speech_ended": {"occurred_at_ms": 900}, "final_transcript": {"occurred_at_ms": 950, "last_at_ms": 2000, "count": 3}, "end_of_utterance": {"occurred_at_ms": 2000, "transcription_delay_ms": 100}}
    w = one(spark, {"type": "stt", "started_at_ms": 0, "ended_at_ms": 2500, "milestones": ms}).select(spans.speech_window().alias("w")).first().w
    assert (w.end_ms, w.end_from_repeated_finals) == (1900, True)


def test_words_on_another_clock_are_not_an_onset(spark):
    op = {"type": "stt", "started_at_ms": 9000, "ended_at_ms": 9900, "response": {"words": [{"text": "x", "start": 6.0, "end": 9.8}]}, "milestones": {"speech_started": {"occurred_at_ms": 9000}}}
    w = one(spark, op).select(spans.speech_window().alias("w")).first().w
    assert (w.start_ms, w.end_ms, w.word_clock_mismatch, w.from_word_timestamps) == (9000, 9800, True, False)


def test_model_and_voice_timings(spark, operations):
    ops = packages.read_operations(spark, f"{operations}/*/events.jsonl").filter("turn_id = 't1'")
    got = {r.type: (r.ttft, r.audio, r.synthesis) for r in ops.select("type", spans.llm_ttft_ms().alias("ttft"), spans.tts_first_audio_ms().alias("audio"), spans.tts_synthesis_ms().alias("synthesis")).collect()}
    assert got["llm"][0] == 200 and got["tts"][1:] == (400, 700)


def test_completions_whole_and_streamed(spark):
    whole = json.dumps({"choices": [{"message": {"content": "yes"}, "finish_reason": "stop"}], "usage": {"total_tokens": 7, "cost": 0.25}})
    events = "\n".join("data: " + json.dumps({"choices": [{"delta": {"content": c}, "finish_reason": f}]}) for c, f in (("y", None), ("es", "stop"))) + "\ndata: [DONE]"
    df = spark.createDataFrame([(whole,), (events,)], "body string")
    got = df.select(spans.decoded_completion(F.col("body")).alias("d"), spans.reported_cost(F.col("body")).alias("cost")).collect()
    assert [(r.d.text, r.d.finish_reason) for r in got] == [("yes", "stop"), ("yes", "stop")]
    assert got[0].d.total_tokens == 7 and got[0].cost == 0.25 and got[1].cost is None


def test_messages_of_a_cut_body(spark):
    cut = '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hel'
    got = spark.createDataFrame([(cut,)], "body string").select(spans.salvaged_messages(F.col("body")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [("user", "hi")]


def test_cycles_and_orphans_fold_nothing(spark):
    rows = [("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("s", "x", "y"), ("s", "y", "x"), ("s", "z", "y"), ("s", "o", "gone")]
    got = {r.turn_id: r.root for r in facts.fold_roots(spark.createDataFrame(rows, "session_id string, turn_id string, continues_turn string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y", "z": "z", "o": "o"}


def test_a_commit_is_claimed_once(spark):
    turns = spark.createDataFrame([("s", "t1", 0, 1000), ("s", "t2", 900, 2000)], "session_id string, turn_id string, start_ms long, end_ms long")
    commits = spark.createDataFrame([("s", 1, 950, 1200), ("s", 2, 1900, 2300)], "session_id string, commit_id long, audio_end_ms long, at_ms long")
    assert {(r.turn_id, r.commit_id) for r in challenger.claimed_commits(turns, commits).collect()} == {("t1", 1), ("t2", 2)}


def test_segments_on_one_clock(spark):
    df = spark.sql("select array(struct(0.0d as start_ms, 900.0d as end_ms, 1000.0d as cursor_ms), struct(0.0d as start_ms, 500.0d as end_ms, 2000.0d as cursor_ms)) as s")
    got = df.select(challenger.rebased_segments(F.col("s")).alias("o")).first().o
    assert [(x.start_ms, x.end_ms) for x in got] == [(0.0, 900.0), (1500.0, 2000.0)]


def test_peaks_of_blocks(spark):
    import numpy as np

    pcm = np.array([0, 100, -32767, 5, 7, 9], "<i2").tobytes()
    df = spark.createDataFrame([("a", 0, bytearray(pcm[:6])), ("a", 3, bytearray(pcm[6:]))], "path string, first_frame long, content binary")
    assert {(r.bucket, r.peak, r.level) for r in challenger.peaks(df, 2).collect()} == {(0, 100, 3), (1, 32767, 1000), (2, 9, 0)}


def test_objects_that_do_not_match(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.bin").withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    declared = spark.createDataFrame([("a.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("b.bin", 1, "0")], "path string, bytes long, sha256 string")
    assert [(r.path, r.reason) for r in packages.verify_objects(files, declared).collect()] == [("b.bin", "missing")]


def test_ranges_and_routes():
    day = 86_400_000
    with pytest.raises(ValueError):
        Filters(5, 5)
    with pytest.raises(ValueError):
        Filters(0, 181 * day)
    assert route(10, Filters(0, day)) == "exact" and route(60_000, Filters(0, day)) == "rollup" and route(60_000, Filters(0, day, provider="x")) == "refused"
    assert bucket_size_ms(day) == 3_600_000


def test_provider_names_collapse(spark):
    raw = ["deepgram-stt", "Deepgram", "eastus.api.cognitive.microsoft.com", "llm", "host.example.org", "Acme Voice", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    assert [r.p for r in df.select("i", canonical_provider(F.col("raw")).alias("p")).orderBy("i").collect()] == ["deepgram", "deepgram", "azure-openai", None, None, "acme-voice", None, None]


def test_repairs_name_what_they_change(spark):
    ms = {"final_transcript": {"occurred_at_ms": 700}}
    spoken = {"type": "stt", "scope": "turn", "status": "error", "error": {"name": "X", "message": "llm_error: timeout"}, "started_at_ms": 100, "ended_at_ms": 9000, "duration_ms": 8900, "milestones": ms}
    socket = {"type": "stt", "scope": "connection", "status": "cancelled", "started_at_ms": 0, "ended_at_ms": 5}
    fine = {"type": "llm", "scope": "turn", "status": "error", "error": {"name": "X", "message": "llm_error"}, "ended_at_ms": 3}
    got = [one(spark, x).select(spans.repaired(F.lit("completed")).alias("r")).first().r for x in (spoken, socket, fine)]
    assert [(r.status, r.ended_at_ms, r.change) for r in got] == [("ok", 700, "error_of_the_model"), ("ok", 5, "closed_by_teardown"), ("error", 3, None)]
    assert got[0].duration_ms == 600


def test_sockets_are_no_turns(spark):
    rows = [{"type": "stt", "response": {"transcript": "a"}}, {"type": "stt", "scope": "connection"}, {"type": "stt", "response": {"close_code": 1000}}, {"type": "stt", "response": {"status": 101}}, {"type": "llm"}]
    assert [one(spark, x).filter(spans.is_stt_turn()).count() for x in rows] == [1, 0, 0, 0, 0]


def test_phases_and_audio_windows(spark):
    ms = {"final_transcript": {"occurred_at_ms": 1900}, "speech_started": {"occurred_at_ms": 1000, "count": 2}}
    r = one(spark, {"type": "stt", "started_at_ms": 1000, "milestones": ms}).select(spans.milestone_phases("stt").alias("p"), spans.audio_window().alias("w")).first()
    assert [(x.name, x.offset_ms, x["count"]) for x in r.p] == [("speech_started", 0, 2), ("final_transcript", 900, 1)] and (r.w.start_ms, r.w.end_ms) == (1000, 1900)
    voice = one(spark, {"type": "tts", "started_at_ms": 0, "milestones": {"audio_chunk": {"occurred_at_ms": 50}}, "response": {"audio_ms": 200.0}}).select(spans.audio_window().alias("w")).first().w
    assert (voice.start_ms, voice.end_ms) == (50, 250)


def test_manifests_runs_and_recordings(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"session_id": "s", "capture_status": {"events_complete": False, "dropped_event_count": 2}, "audio": {"user": {"file": "u.wav"}, "agent": {"file": "a.wav"}}}))
    manifests = packages.read_manifests(spark, str(tmp_path / "m.json"))
    row = manifests.select("outcome", "metadata", spans.capture_warnings().alias("w")).first()
    assert (row.outcome, row.metadata, row.w) == ("unknown", {}, ["events_incomplete", "events_dropped"])
    files = spark.createDataFrame([("s", "u.wav", 10)], "session_id string, file string, length long")
    assert {(r.file, r.present) for r in packages.recordings_inventory(manifests, files).collect()} == {("u.wav", True), ("a.wav", False)}
    for n, (kind, words, at) in enumerate([("streaming", [], "2026-01-03"), ("batch", [{"text": "a", "start": 1.5, "end": 2.0}], "2026-01-02"), ("batch", None, "2026-01-04")]):
        (tmp_path / f"r{n}.json").write_text(json.dumps({"session_id": "s", "model": f"m{n}", "status": "complete", "kind": kind, "created_at": at, "response": {"words": words}}))
    (tmp_path / "r9.json").write_text(json.dumps({"session_id": "s", "status": "complete"}))
    runs = packages.read_challenger_runs(spark, str(tmp_path / "r*.json"))
    assert {r.model: r.recency for r in runs.collect()} == {"m2": 1, "m0": 2, "m1": 3}
    best = challenger.selected_run(runs).first()
    assert best.model == "m1" and best.words[0].start_ms == 1500
