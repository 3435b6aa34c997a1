"""Facts of calls from their packages: spans and audio chunks to turns, calls, tools, failures.

A turn's reply latency runs from the caller's last word to the first audio of the agent
that could be heard. The rows have the columns that measures and reports work on, so a
dashboard over packages is the same code as one over any other turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import spans
from callmetrics.functions.scalars import LAG_MS, MIN_REPLY_MS, canonical_provider, capture_incomplete, epoch_ms, error_fingerprint, has_failed, is_interrupted, is_timeout, provider_words, session_status
from callmetrics.operators.facts import STAGES, folding, split_marks
from callmetrics.operators.intervals import overlaps
from callmetrics.sources.shared import checkpointed

#: Cells in which agent chunks meet the syntheses that may have made them.
CHUNK_CELL_MS = 60_000
#: Timing of a recognition that turns have.
TIMING = ("time_to_first_partial_ms", "endpoint_delay_ms", "endpoint_unmeasurable_reason", "final_from_last_word_ms", "missing_final", "forced_flush")


def in_turns(ops: DataFrame) -> DataFrame:
    return ops.filter(F.col("turn_id").isNotNull() & ~F.coalesce(F.col("scope") == "connection", F.lit(False)))


def _measured(ops: DataFrame, **more: Column) -> DataFrame:
    """Adds columns of their own: what is read of each recognition's milestones and words
    (part_*), its speech window (window_*) and capture profile (profile_*), NULL for other
    spans. They are made in steps, so that none is computed again where it is used. ``more``
    are made in the first: with the words' lambda in it, Spark compiles that step in small
    methods, and long rules of names make no method too large for the JVM to optimise."""
    only = lambda prefix, fields: {f"{prefix}_{n}": F.when(F.col("type") == "stt", v) for n, v in fields.items()}
    ops = ops.withColumns(only("part", spans.recognition_parts()) | only("profile", spans.profile_fields()) | more)
    return ops.withColumns(only("window", spans.window_fields(_made("part", spans.recognition_parts()))))


def _made(prefix: str, fields: dict[str, Column]) -> dict[str, Column]:
    return {n: F.col(f"{prefix}_{n}") for n in fields}


def _latency() -> dict[str, Column]:
    """Timing of a recognition, from the columns that _measured() adds."""
    parts = _made("part", spans.recognition_parts())
    return spans.latency_fields(_made("window", spans.window_fields(parts)), _made("profile", spans.profile_fields()), parts)


def _captured_windows() -> tuple[Column, Column]:
    """What a span itself says of when it could be heard: a recognition, by the columns of
    _measured(), and a synthesis without chunks."""
    source = F.when(F.col("window_from_word_timestamps"), "word_timestamps").when(F.col("window_end_from_repeated_finals"), "final_transcripts").otherwise("speech_milestones")
    spoken = F.when((F.col("window_end_ms") >= F.col("window_start_ms")) & ~_connection(), F.struct(F.col("window_start_ms").alias("from_ms"), F.col("window_end_ms").alias("to_ms"), source.alias("source")))
    first, length = spans.raw_milestone_ms("audio_chunk", "first_byte"), F.col("response.audio_ms")
    told = F.when(_voice() & (length > 0) & first.isNotNull(), F.struct(F.bround(first).cast("long").alias("from_ms"), F.bround(first + length).cast("long").alias("to_ms"), F.lit("inferred_response_audio_duration").alias("source")))
    return spoken, told


def _connection() -> Column:
    return F.coalesce(F.col("scope") == "connection", F.lit(False))


def _voice() -> Column:
    return F.coalesce((F.col("type") == "tts") & ~_connection(), F.lit(False))


def _shown(ops: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``shown`` to spans with ``spoken`` and ``told``, in whose place it comes."""
    at = F.coalesce("playout_at_ms", "occurred_at_ms")
    agent = chunks.filter("track = 'agent' and duration_ms > 0").withColumn("from_ms", F.bround(at).cast("long")).withColumn("to_ms", F.bround(at + F.col("duration_ms")).cast("long")).filter("from_ms is not null")
    extent = lambda rows, *keys: rows.groupBy("session_id", *keys).agg(F.struct(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"), F.lit("attributed_audio_chunks").alias("source")).alias("played"))
    own = extent(agent.filter("operation_id is not null"), F.col("operation_id").alias("event_id")).withColumnRenamed("played", "own")
    loose = extent(agent.filter("operation_id is null and turn_id is not null"), "turn_id").withColumnRenamed("played", "loose")
    met = ops.filter(_voice()).join(own, ["session_id", "event_id"], "left").join(loose, ["session_id", "turn_id"], "left")  # no other span has chunks to meet
    met = met.withColumn("shown", F.coalesce("own", "loose", "told")).select(*ops.columns, "shown")
    return ops.filter(~_voice()).withColumn("shown", F.col("spoken")).unionByName(met).drop("spoken", "told")


def presentation_windows(ops: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``shown`` {from_ms, to_ms, source}: when a person could be heard.

    A recognition's is its speech window. A synthesis' is the extent of its own chunks,
    else of chunks of its turn that name no operation, else its first audio and the
    length it reports; NULL where none was captured. Connections have none.
    """
    spoken, told = _captured_windows()
    return _shown(_measured(ops).select(*ops.columns, spoken.alias("spoken"), told.alias("told")), chunks)


def _counts_tokens() -> Column:
    r = F.col("response")
    return r["total_tokens"].isNotNull() | r["completion_tokens"].isNotNull() | r["ttft_ms"].isNotNull()


def logical_llm_calls(ops: DataFrame) -> DataFrame:
    """Model calls of turns without the transport attempts whose start lies in a span
    of the same turn that accounts for tokens; attempts that none covers stay."""
    llm = in_turns(ops).filter("type = 'llm'").withColumn("counts_tokens", _counts_tokens())
    start = F.coalesce("started_at_ms", F.lit(0))
    frame = llm.filter("counts_tokens").groupBy("session_id", "turn_id").agg(F.collect_list(F.struct(start.alias("a"), F.coalesce("ended_at_ms", start).alias("b"))).alias("frames"))  # the model calls of one turn
    covered = F.coalesce(F.exists("frames", lambda f: (start >= f["a"]) & (start <= f["b"])), F.lit(False))
    return llm.join(frame, ["session_id", "turn_id"], "left").filter(F.col("counts_tokens") | ~covered).drop("frames", "counts_tokens")


def _first(stage: str, value: Column, *before: Column) -> Column:
    """``value`` of the stage's first span in a turn, by what goes before, start and id."""
    mine = F.col("type") == stage
    return F.min_by(F.when(mine, value), F.when(mine, F.struct(*(b.alias(f"b{i}") for i, b in enumerate(before)), F.coalesce("started_at_ms", F.lit(0)).alias("at"), "event_id")))


def timed(ops: DataFrame) -> DataFrame:
    """Adds ``window``, ``profile`` and ``m``: speech window, capture profile and timing of
    recognitions, NULL for other spans."""
    only = lambda fields: F.when(F.col("type") == "stt", spans.struct_of(fields))
    window, profile = _made("window", spans.window_fields(spans.recognition_parts())), _made("profile", spans.profile_fields())
    return _measured(ops).select(*ops.columns, only(window).alias("window"), only(profile).alias("profile"), only(_latency()).alias("m"))


def measured_spans(ops: DataFrame, *beside: str | Column) -> DataFrame:
    """What facts are made of: a row a span with what is measured of it in place of the
    milestones, words, samples and texts that were captured, and the columns ``beside``.
    These rows are much narrower than spans are, so lines can be parsed and measured in
    one pass and only this be written."""
    at = lambda stage: F.col("type") == stage
    provider = F.coalesce(canonical_provider(F.col("provider"), F.col("provider_words")), canonical_provider(F.col("endpoint_id"), F.col("endpoint_words")))
    spoken, told = _captured_windows()
    timing = {n: _latency()[n] for n in TIMING}
    named = ops.withColumn("provider_words", provider_words(F.col("provider"))).withColumn("endpoint_words", provider_words(F.col("endpoint_id")))
    plain = {  # what needs no window
        "vendor": provider, "version": F.nullif(F.lower(F.trim("model")), F.lit("")), "told": told, "failed": has_failed(F.col("status"), F.col("error.name")), "interrupted": is_interrupted(F.col("status"), F.col("error.name")),
        "inferred": F.col("response.reply_attribution") == "inferred", "continues_turn": F.when(at("stt"), F.col("response.continues_turn")), "reply_skipped": F.when(at("stt"), F.col("response.reply_skipped")),
        "ttft": F.when(at("llm"), spans.llm_ttft_ms()), "tokens": F.when(at("llm"), spans.token_counts()), "counts_tokens": F.when(at("llm"), _counts_tokens()),
        "audio_at": F.when(at("tts"), spans.raw_milestone_ms("audio_chunk")), "first_audio": F.when(at("tts"), spans.tts_first_audio_ms()), "synthesis": F.when(at("tts"), spans.tts_synthesis_ms()),
    }
    return _measured(named, **plain).select(
        *beside, "session_id", "turn_id", "event_id", "type", "scope", "status", "endpoint_id", "started_at_ms", "ended_at_ms", "duration_ms", "error", F.struct("request.name").alias("request"),
        *plain, spoken.alias("spoken"), *(v.alias(n) for n, v in timing.items()), F.col("window_from_word_timestamps").alias("worded"),
    )


def _grouped(measured: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their first spans, written once, and (session_id, turn_id, received) of
    those whose synthesis does not say when it was heard. ``measured`` are measured_spans()."""
    at = lambda stage: F.col("type") == stage
    start = F.coalesce("started_at_ms", F.lit(0))
    call = F.struct("counts_tokens", start.alias("a"), F.coalesce("ended_at_ms", start).alias("b"), F.coalesce("duration_ms", F.lit(0)).alias("ms"))
    own = in_turns(measured).drop("endpoint_id", "error", "request")
    parts = int(measured.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shown = _shown(own, chunks)
    own = shown.select("*", F.col("shown.from_ms").alias("from_ms"), F.col("shown.to_ms").alias("to_ms")).drop("scope", "shown")
    own = own.repartition(parts, "session_id", "turn_id")  # plain columns: structs of all stages in one projection are a method too large for the JVM to optimise
    length = F.col("to_ms") - F.col("from_ms")  # a span that was heard has both
    provider, model = F.col("vendor").alias("provider"), F.col("version").alias("model")
    stt = F.struct(
        provider, model, F.struct(*TIMING).alias("m"), "worded", F.coalesce("to_ms", "ended_at_ms").alias("spoke_until"),
        F.coalesce(length, "duration_ms").alias("speech_ms"), "continues_turn", "reply_skipped",
    )
    llm = F.struct(provider, model, "ttft", "duration_ms", "tokens")
    tts = F.struct(
        provider, model, F.coalesce("from_ms", "audio_at").cast("double").alias("heard"), F.col("started_at_ms").alias("a"), F.col("ended_at_ms").alias("b"),
        "first_audio", "synthesis", "duration_ms", length.alias("audible_ms"),
    )
    turns = own.groupBy("session_id", "turn_id").agg(
        F.min(start).alias("started_at_ms"), F.max(F.coalesce("ended_at_ms", start)).alias("ended_at_ms"), F.max((F.col("status") == "error").cast("int")).alias("__error"), F.max((F.col("status") == "cancelled").cast("int")).alias("__cancelled"),
        _first("stt", stt).alias("stt"), _first("llm", llm, F.col("ttft").isNull()).alias("llm"), _first("tts", tts).alias("tts"),
        F.coalesce(F.bool_or("inferred"), F.lit(False)).alias("inferred_reply"),
        F.bround(F.sum(F.when(at("tool"), F.col("duration_ms")))).cast("long").alias("tool_total_ms"),
        *(F.count_if(at(s)).alias(f"{s}_ops") for s in STAGES), *(F.count_if(at(s) & F.col("failed")).alias(f"{s}_failed") for s in STAGES), F.count_if(at("tts") & F.col("interrupted")).alias("tts_interrupted"),
        F.collect_list(F.when(at("llm"), call)).alias("calls"),
    )
    kept = F.filter("calls", lambda c: c["counts_tokens"] | ~F.exists("calls", lambda f: f["counts_tokens"] & (c["a"] >= f["a"]) & (c["a"] <= f["b"])))  # logical_llm_calls() of one turn
    turns = turns.withColumn("calls", kept).withColumn("llm_ms", F.nullif(F.aggregate("calls", F.lit(0).cast("long"), lambda t, c: t + c["ms"]), F.lit(0))).withColumn("llm_calls", F.size("calls"))
    turns = checkpointed(turns.drop("calls"))  # read for its silent turns and as a whole
    silent = turns.filter("tts is not null and tts.heard is null and tts.b >= tts.a").select("session_id", F.col("turn_id").alias("l_id"), F.col("tts.a").alias("l_from"), (F.col("tts.b") + 1).alias("l_to"))
    received = chunks.filter("track = 'agent' and occurred_at_ms is not null").groupBy("session_id", F.floor("occurred_at_ms").alias("r_from")).agg(F.min("occurred_at_ms").alias("at"))  # bounds are whole, so one of a millisecond tells
    received = overlaps(silent, received.withColumn("r_to", F.col("r_from") + 1), ["session_id"], CHUNK_CELL_MS).filter("at >= l_from and at < l_to").groupBy("session_id", F.col("l_id").alias("turn_id")).agg(F.min("at").alias("received"))
    return turns, received


def _continues() -> Column:
    return F.nullif(F.col("stt.continues_turn"), F.lit(""))


def _measurements() -> list[Column | str]:
    """The columns of grouped_turns(), from both tables of _grouped()."""
    wait = F.coalesce("tts.heard", "received") - F.col("stt.spoke_until")
    status = F.when((F.col("__error") == 1) | F.coalesce(F.col("stt.reply_skipped") == "callback_error", F.lit(False)), "error").when(F.col("__cancelled") == 1, "cancelled").otherwise("ok")
    m = F.col("stt.m")
    return [
        "session_id", "turn_id", "started_at_ms", "ended_at_ms", F.greatest(F.col("ended_at_ms") - F.col("started_at_ms"), F.lit(0)).alias("duration_ms"), status.alias("status"),
        F.bround(F.when(wait >= MIN_REPLY_MS, wait)).cast("long").alias("response_ms"), F.col("stt.speech_ms").alias("user_speech_ms"), F.col("stt.reply_skipped").alias("reply_skipped"),
        _continues().alias("continues_turn"), "inferred_reply",
        F.when(F.col("stt.worded"), m["time_to_first_partial_ms"]).alias("stt_first_partial_ms"),
        F.when(F.col("stt").isNull(), "stage_absent").when(~F.col("stt.worded"), "speech_onset_not_observed").alias("stt_first_partial_unmeasurable_reason"),
        m["endpoint_delay_ms"].alias("stt_endpoint_delay_ms"), m["endpoint_unmeasurable_reason"].alias("stt_endpoint_unmeasurable_reason"), m["final_from_last_word_ms"].alias("stt_final_ms"),
        F.coalesce(m["missing_final"], F.lit(False)).alias("stt_missing_final"), F.coalesce(m["forced_flush"], F.lit(False)).alias("stt_forced_flush"),
        F.col("llm.ttft").alias("llm_ttft_ms"), F.col("llm.duration_ms").alias("llm_completion_ms"), F.col("llm.tokens.input").alias("llm_input_tokens"), F.col("llm.tokens.output").alias("llm_output_tokens"),
        "llm_ms", F.coalesce("llm_calls", F.lit(0)).cast("long").alias("llm_calls"), F.col("tts.first_audio").alias("tts_first_audio_ms"), F.col("tts.synthesis").alias("tts_synthesis_ms"),
        F.col("tts.duration_ms").alias("tts_ms"), F.col("tts.audible_ms").alias("audible_tts_ms"), F.col("tool_ops").alias("tool_count"), "tool_total_ms",
        *(f"{s}_ops" for s in STAGES), *(f"{s}_failed" for s in STAGES), "tts_interrupted", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in STAGES[:3] for c in ("provider", "model")),
    ]


def grouped_turns(ops: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a turn with every measurement of it, on the call's clock.

    Spans that start together are taken by id. A turn whose recognition says that its
    callback failed is an error even though no span reports one. ``response_ms`` is the
    wait from the caller's last word to the agent's first audio, at least MIN_REPLY_MS:
    from the synthesis' window, else its milestone, else the first agent chunk received
    within its span.
    """
    turns, received = _grouped(measured_spans(ops), chunks)
    return turns.join(received, ["session_id", "turn_id"], "left").select(*_measurements())


def turn_metrics(ops: DataFrame, chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Grouped turns with their place in exchanges (is_continuation,
    has_continuation, <stage>_split, root), their call's agent, and ``started_ms`` and
    ``ended_ms`` on the clock of the world, NULL where the call states no start."""
    return measured_turns(measured_spans(ops), chunks, manifests)


def measured_turns(measured: DataFrame, chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """turn_metrics() of spans that measured_spans() has measured."""
    began = manifests.select("session_id", "agent_id", epoch_ms(F.col("started_at")).alias("__began"))
    turns, received = _grouped(measured, chunks)
    folds = folding(turns.select("session_id", "turn_id", _continues().alias("continues_turn"), *(f"{s}_ops" for s in STAGES)))
    few = received.join(folds, ["session_id", "turn_id"], "full")  # so that all turns are joined once
    whole = turns.join(few, ["session_id", "turn_id"], "left").join(began, "session_id", "left")
    clock = ((F.col("__began") + F.col(f"{c}_at_ms")).alias(f"{c}_ms") for c in ("started", "ended"))
    return whole.select(*_measurements(), *(v.alias(n) for n, v in split_marks().items()), "agent_id", *clock)


def call_metrics(turns: DataFrame, manifests: DataFrame, ops: DataFrame) -> DataFrame:
    """One row a call, those without turns too. ``turns`` counts exchanges: a turn
    that continues one that is there is not counted again, and an exchange with any
    reply that was placed by inference counts once among ``inferred_reply_turns``."""
    failed = sum((F.col(f"{s}_failed") for s in STAGES[1:]), F.col("stt_failed"))
    own = turns.groupBy("session_id").agg(
        F.count_if(~F.col("is_continuation")).alias("turns"), F.count_if("is_continuation").alias("split_turns"), F.countDistinct(F.when(F.col("inferred_reply"), F.col("root"))).alias("inferred_reply_turns"),
        *(F.sum(f"{s}_failed").alias(f"{s}_failed") for s in STAGES), F.sum(failed).alias("failed_ops"), F.sum("tts_interrupted").alias("interrupted"), F.count_if(F.col("response_ms") >= LAG_MS).alias("lag_turns"),
        F.count("response_ms").alias("measured"), F.count_if("stt_missing_final").alias("missing_final_turns"), F.max("response_ms").alias("max_response_ms"),
    )
    counted = ops.groupBy("session_id").agg(F.count("*").alias("__ops"))
    text = lambda *names: F.coalesce(*(F.nullif(F.trim(F.try_element_at("metadata", F.lit(n))), F.lit("")) for n in names))
    c = F.col("capture_status")
    dropped = F.coalesce(c["dropped_event_count"], F.lit(0)) + F.coalesce(c["dropped_audio_chunk_count"], F.lit(0))
    calls = manifests.join(own, "session_id", "left").join(counted, "session_id", "left")
    counts = ["turns", "split_turns", "inferred_reply_turns", *(f"{s}_failed" for s in STAGES), "failed_ops", "interrupted", "lag_turns", "measured", "missing_final_turns"]
    return calls.select(
        "session_id", "agent_id", text("environment", "env").alias("environment"), text("agent_version", "version").alias("agent_version"), F.nullif(F.trim("sdk.language"), F.lit("")).alias("sdk_language"),
        F.nullif(F.trim("sdk.version"), F.lit("")).alias("sdk_version"), epoch_ms(F.col("started_at")).alias("started_ms"), "duration_ms", "outcome", session_status(F.coalesce("__ops", F.lit(0)), c["coverage_complete"]).alias("status"),
        *(F.coalesce(n, F.lit(0)).alias(n) for n in counts), "max_response_ms", capture_incomplete(c["events_complete"], c["audio_complete"], dropped, F.lit(True)).alias("capture_incomplete"),
    )


def tool_metrics(ops: DataFrame) -> DataFrame:
    """A10: one row a tool span of a turn."""
    name = F.substring(F.coalesce(F.nullif(F.col("request.name"), F.lit("")), F.nullif(F.col("endpoint_id"), F.lit("")), F.lit("unnamed")), 1, 120)
    status, error = F.col("status"), F.col("error")
    return in_turns(ops).filter("type = 'tool'").select("session_id", "turn_id", F.col("event_id").alias("op_id"), name.alias("tool_name"), "duration_ms", has_failed(status, error["name"]).alias("failed"), is_timeout(status, error["name"], error["message"]).alias("timed_out"))


def failure_metrics(ops: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row a fault, those of connections too."""
    began = manifests.select("session_id", "agent_id", epoch_ms(F.col("started_at")).alias("__began"))
    faults = ops.withColumn("fingerprint", error_fingerprint(F.col("type"), F.col("status"), F.col("error.name"))).filter("fingerprint is not null")
    return faults.join(began, "session_id", "left").select("session_id", "turn_id", F.col("event_id").alias("op_id"), F.col("type").alias("stage"), "agent_id", (F.col("__began") + F.col("started_at_ms")).alias("started_ms"), "fingerprint")
