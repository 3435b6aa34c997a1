"""Whole-call evaluation of recognition: shape, budget, quality, reports, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions.scalars import verdict, wer_band
from callmetrics.functions.text import normalized, token_edit_distance, tokens
from callmetrics.operators.measures import linear_percentiles, newest

EARLY_END_MS, LATE_END_MS = -1000, 1000


def partial_revisions(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Word edits between consecutive hypotheses (seq, text) of each turn, and how many
    there were; NULL edits where any of them is marked ``truncated``."""
    order = Window.partitionBy(*keys).orderBy("seq")
    rows = partials.filter("text is not null").withColumn("t", tokens(normalized(F.col("text")))).withColumn("before", F.lag("t").over(order))
    edits = F.when(F.col("before").isNotNull(), token_edit_distance(F.col("before"), F.col("t")))
    each = rows.withColumn("edits", edits).groupBy(*keys).agg(F.count("*").alias("hypotheses"), F.coalesce(F.sum("edits"), F.lit(0)).alias("revisions"), F.max("truncated").alias("truncated"))
    return each.withColumn("revisions", F.when(~F.col("truncated"), F.col("revisions"))).drop("truncated")


def turn_shape(turns: DataFrame, keys: list[str]) -> DataFrame:
    """By call, how many turns never got a final, were not closed by a turn's end, were
    cut off early or ended late (together: split or merged), or were forced, and which (ids
    in order; the turns of one call)."""
    error = F.col("position_error_ms")
    kinds = {"missing_final": F.col("missing_final"), "non_turn_final": ~F.col("is_turn_final"), "premature": error < EARLY_END_MS, "late": error > LATE_END_MS, "forced": F.col("forced_flush")}
    own = turns if "is_turn_final" in turns.columns else turns.withColumn("is_turn_final", F.lit(None).cast("boolean"))
    counts = own.groupBy(*keys).agg(
        F.count("*").alias("measured_turns"), *(F.count_if(F.coalesce(when, F.lit(False))).alias(name) for name, when in kinds.items()),
        *(F.sort_array(F.collect_list(F.when(when, F.col("turn_id")))).alias(f"{name}_turns") for name, when in kinds.items()),
    )
    return counts.withColumn("split_or_merged", F.col("premature") + F.col("late"))


def response_budget(turns: DataFrame, keys: list[str]) -> DataFrame:
    """The recogniser's share of endpoint + model + voice, and the wait with the
    challenger's endpoint in its place; only turns where every part was measured."""
    total = F.col("endpoint_ms") + F.col("llm_ms") + F.col("tts_ms")
    whole = turns.withColumn("share", F.when(total > 0, F.col("endpoint_ms") / total)).withColumn("other_wait", F.col("wait_ms") - F.col("endpoint_ms") + F.col("challenger_endpoint_ms"))
    return whole.groupBy(*keys).agg(F.count("share").alias("n"), F.round(F.percentile("share", F.lit(0.5)), 6).alias("share_p50"), F.round(F.percentile("other_wait", F.lit(0.5)), 6).alias("wait_p50"))


def length_agreement(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Characters of both sides over turns whose capture kept lengths only."""
    only = turns.filter("production_chars is not null and challenger_chars is not null")
    return only.groupBy(*keys).agg(F.count("*").alias("turns"), F.sum("production_chars").alias("production_chars"), F.sum("challenger_chars").alias("challenger_chars"), F.round(F.try_divide(F.sum("production_chars"), F.sum("challenger_chars")), 6).alias("ratio"))


def capabilities(turns: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Which captures any turn of a call had, and its run's state."""
    state = F.when(F.count("run_status") == 0, "not_run").when(F.max((F.col("run_status") == "failed").cast("int")) == 1, F.when(F.max((F.col("run_status") == "complete").cast("int")) == 1, "partial").otherwise("failed")).otherwise("ready")
    return turns.groupBy(*keys).agg(*(F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags), state.alias("state"))


def stt_quality(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Recognition spans of a call: rows, texts present, first partial and end of
    turn as seen from the milestones, and the endpointing setting if it is one."""
    one = F.when(F.count_distinct("endpointing_ms") == 1, F.max("endpointing_ms"))
    p50 = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c})")
    return ops.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.trim("transcript") != "", F.lit(False))).alias("transcripts"), p50("first_partial_ms").alias("first_partial_p50"), p50("finalization_ms").alias("finalization_p50"), one.alias("endpointing_ms"), (F.count_distinct("endpointing_ms") > 1).alias("endpointing_varies"))


def transcript(messages: DataFrame) -> DataFrame:
    """Each message of a call once. Requests (op_id) resend the history; the n-th
    message of equal role and text is the same message in all of them, first seen in the
    earliest. A reply that is the beginning of a longer one of the same call was cut, and
    gives way to it; a message that answers a tool call is told from others by its id
    (``tool_call_id``, if there is such a column).

    In the order of texts, one that begins any other is followed by one that it begins,
    so each text is compared with its successor only.
    """
    rows = messages if "tool_call_id" in messages.columns else messages.withColumn("tool_call_id", F.lit(None).cast("string"))
    same = ["session_id", "role", "text", "tool_call_id"]
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "op_id").orderBy("position")))
    once = nth.groupBy(*same, "nth").agg(F.min(F.struct("op_id", "position")).alias("seen"))
    replies = once.filter("role = 'assistant' and text <> ''").select("session_id", "text").distinct()
    after = F.lead("text").over(Window.partitionBy("session_id", F.substring("text", 1, 1)).orderBy("text"))
    cut = replies.withColumn("after", after).filter("startswith(after, text)").select("session_id", "text", F.lit("assistant").alias("role"))
    return once.join(cut, ["session_id", "role", "text"], "left_anti").select("session_id", "role", "text", F.col("seen.op_id").alias("op_id"), F.col("seen.position").alias("position"))


def paired_deltas(production: DataFrame, challenger: DataFrame, keys: list[str]) -> DataFrame:
    """Challenger less production for the same turn (session_id, turn_id), where both
    were measured from the same instant: first partials, and finals from the last word.
    Returns for each of ``keys`` and metric the count, percentiles, extremes and mean."""
    pairs = {"first_partial_ms": ("time_to_first_partial_ms", "time_to_first_partial_ms"), "endpoint_delay_ms": ("final_from_last_word_ms", "endpoint_delay_ms")}
    both = production.alias("p").join(challenger.alias("c"), ["session_id", "turn_id"])
    deltas = F.array(*(F.struct(F.lit(name).alias("metric"), (F.col(f"c.{right}") - F.col(f"p.{left}")).alias("delta_ms")) for name, (left, right) in pairs.items()))
    return linear_percentiles(both.select(*keys, F.inline(deltas)).filter("delta_ms is not null"), [*keys, "metric"], "delta_ms")


def call_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """By call, median WER and turns at or over 0.10 and over 0.25."""
    return scored.groupBy(*keys).agg(F.round(F.percentile("wer", F.lit(0.5)), 6).alias("median_wer"), F.count_if(F.col("wer") >= 0.10).alias("moderate_or_worse"), F.count_if(F.col("wer") > 0.25).alias("high"))


#: Statuses of turns that count towards a call's score: a turn that production missed is a result.
SCORED = ("evaluated", "possible_missed_speech")
BANDS = ("low", "moderate", "high", "unavailable")
RISKS = ("none", "low", "medium", "high", "unavailable")


def worst_turns(scored: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Of each call, the scored turns with the highest error rate; every task passes on no more than these."""
    own = scored.filter(F.col("status").isin(*SCORED))
    order = [F.coalesce("wer", F.lit(0.0)).desc(), F.col("turn_id")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return newest(own, keys, order, most).withColumn("place", place)


def accuracy(scored: DataFrame, keys: list[str]) -> DataFrame:
    """X11: by call, turns and those scored, pooled error rate and its band, turns by band."""
    counts = scored.withColumn("__in", F.col("status").isin(*SCORED))
    own = lambda c: F.coalesce(F.sum(F.when(F.col("__in"), F.col(c))), F.lit(0))
    sums = counts.groupBy(*keys).agg(
        F.count("*").alias("turns"), F.count_if("__in").alias("scored"), F.count_if(F.col("status") == "evaluated").alias("evaluated"), own("errors").alias("errors"), own("words").alias("words"), *(F.count_if(F.col("band") == b).alias(f"band_{b}") for b in BANDS)
    )
    return sums.withColumn("wer", F.round(F.try_divide("errors", "words"), 6)).withColumn("band", wer_band(F.col("wer"))).withColumn("available", F.col("scored") > 0)


def risks(turns: DataFrame, keys: list[str]) -> DataFrame:
    """X11: by call, turns by what their differences could do to its outcome."""
    at = lambda r: F.count_if(F.coalesce("risk", F.lit("unavailable")) == r)
    return turns.groupBy(*keys).agg(*(at(r).alias(f"risk_{r}") for r in RISKS), (at("high") + at("medium")).alias("outcome_risk_turns"))


def evaluation_report(scored: DataFrame, latency: DataFrame, costs: DataFrame, risk: DataFrame | None = None, runs: DataFrame | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """X11, Q06: one row a call: its coverage and accuracy, latency and cost, and if given the
    risks of its differences, what its runs are (run_metadata()) and how it ranks among others."""
    nest = lambda df, name: df.select("session_id", F.struct(*[c for c in df.columns if c != "session_id"]).alias(name))
    out = nest(accuracy(scored, ["session_id"]), "accuracy")
    for name, part in (("latency", latency), ("cost", costs), ("risk", risk), ("run", runs), ("cohort", cohort)):
        if part is not None:
            out = out.join(nest(part, name), "session_id", "left")
    return out


def production_capabilities(stt: DataFrame) -> DataFrame:
    """What the recorded recognitions of a call show that production's recogniser gives,
    not what its vendor says: the settings are those of the first request."""
    first = F.min_by("request", F.when(F.col("request").isNotNull(), F.struct("started_at_ms", "event_id")))
    own = stt.groupBy("session_id").agg(
        first.alias("r"), F.max(F.coalesce(F.size(F.try_element_at("samples", F.lit("partial"))["items"]), F.lit(0))).alias("partials"), F.coalesce(F.bool_or(F.size("response.words") > 0), F.lit(False)).alias("word_timestamps"),
        F.bool_or(F.col("response.confidence").isNotNull()).alias("confidence_scores"), F.sort_array(F.collect_set("response.language")).alias("languages"),  # languages of one call
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    return own.select(
        "session_id", (yes(F.col("r.interim_results")) | (F.col("partials") > 0)).alias("streaming_partials"), "word_timestamps", yes(F.col("r.vad_events")).alias("vad_events"), "confidence_scores", "languages",
        (F.size("languages") > 1).alias("multilingual_turns"), F.col("r.sample_rate_hz").alias("sample_rate_hz"),
    )


def challenger_summary(selected: DataFrame, streaming: DataFrame, replays: DataFrame) -> DataFrame:
    """By session, the run that gave the transcript (else the replay): who made it, how
    many words, and what it can do. ``selected`` and ``streaming`` hold a run a session,
    ``replays`` the sessions whose replay was received."""
    words = F.filter("words", lambda w: w["type"] == "word")
    shape = lambda df: df.select("session_id", "provider", "model", "kind", "created_at", F.size(words).alias("word_count"), (F.size("words") > 0).alias("word_timestamps"), F.exists("words", lambda w: w["logprob"].isNotNull()).alias("confidence_scores"))
    replayed = streaming.select("session_id", F.col("model").alias("streaming_model"))
    only = shape(streaming.join(selected.select("session_id"), "session_id", "left_anti"))
    out = shape(selected).unionByName(only).join(replayed, "session_id", "left").join(replays.select("session_id").distinct().withColumn("streaming_partials", F.lit(True)), "session_id", "left")
    return out.withColumn("vad_events", F.col("streaming_model").isNotNull()).withColumn("streaming_partials", F.coalesce("streaming_partials", F.lit(False)))


def run_metadata(scored: DataFrame, runs: DataFrame) -> DataFrame:
    """By session with turns, what was run and how far it came: not_run without a run,
    failed without an evaluated turn, partial with some, ready with all."""
    turns = scored.groupBy("session_id").agg(F.count("*").alias("eligible_turns"), F.count_if(F.col("status") == "evaluated").alias("completed_turns"))
    made = runs.groupBy("session_id").agg(F.count("*").alias("runs"), F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"))
    out = turns.join(made, "session_id", "left")
    done, all_ = F.col("completed_turns"), F.col("eligible_turns")
    state = F.when(F.col("runs").isNull(), "not_run").when(done == 0, "failed").when(done < all_, "partial").otherwise("ready")
    return out.withColumn("state", state).withColumn("runs", F.coalesce("runs", F.lit(0).cast("long")))


def challenger_latency(turns: DataFrame) -> DataFrame:
    """Of each replayed session, the percentiles of what its turns (challenger.stream_latency())
    measured, turns measured, and those that never got a final."""
    own = turns.filter("available")
    metrics = ("time_to_first_partial_ms", "endpoint_delay_ms", "post_end_delay_ms", "streaming_cursor_lag_ms", "partial_count")
    long = own.select("session_id", *(F.col(m).cast("double") for m in metrics)).unpivot(["session_id"], list(metrics), "metric", "value")
    counts = own.groupBy("session_id").agg(F.count("*").alias("measured_turns"), F.count_if("missing_final").alias("missing_final_count"))
    return linear_percentiles(long, ["session_id", "metric"], "value").join(counts, "session_id")


def count_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """How often each value occurs; what was not captured counts as such."""
    return df.groupBy(*keys, F.coalesce(F.col(column).cast("string"), F.lit("not_captured")).alias("value")).agg(F.count("*").alias("n"))


def response_text(body: Column) -> Column:
    """The text that a recogniser's response holds: its transcript, its text, or that of the
    first alternative of the first channel; '' where none of them is a text."""
    paths = ("$.transcript", "$.text", "$.results.channels[0].alternatives[0].transcript")
    return F.coalesce(*(F.nullif(F.get_json_object(body, p), F.lit("")) for p in paths), F.lit(""))


def production_text(stt: Column, llm_user_text: Column, llm_requests: Column) -> Column:
    """The recogniser's own text, else the last user message where exactly one model request carried it."""
    own = F.nullif(F.trim(stt), F.lit(""))
    return F.coalesce(own, F.when(llm_requests == 1, F.nullif(F.trim(llm_user_text), F.lit(""))))


def production_transcripts(stt: DataFrame, llm: DataFrame) -> DataFrame:
    """(session_id, turn_id, said, source) of recognitions (session_id, turn_id, body)
    and model requests (session_id, turn_id, user_text: the last user message of each, or NULL).

    ``source``: stt_response, llm_history_inferred where exactly one request of the turn
    carried a user's message, or unavailable, with '' said.
    """
    one = llm.filter("user_text is not null").groupBy("session_id", "turn_id").agg(F.count("*").alias("__n"), F.min("user_text").alias("__user"))
    both = stt.withColumn("__own", response_text(F.col("body"))).join(one, ["session_id", "turn_id"], "left")
    inferred = F.col("__n") == 1
    said = F.when(F.col("__own") != "", F.col("__own")).when(inferred, F.col("__user")).otherwise("")
    source = F.when(F.col("__own") != "", "stt_response").when(inferred, "llm_history_inferred").otherwise("unavailable")
    return both.select("session_id", "turn_id", said.alias("said"), source.alias("source"))


#: Q07: what is set side by side: dimension, metric, and whether less is better.
HEAD_TO_HEAD = (
    ("accuracy", "no_text_turns", True), ("accuracy", "missing_final_turns", True), ("latency", "final_from_last_word_p50", True), ("latency", "first_partial_p50", True), ("capability", "streaming_partials", False),
    ("capability", "word_timestamps", False), ("capability", "confidence_scores", False), ("capability", "vad_events", False), ("cost", "per_minute", True), ("cost", "per_call", True), ("cost", "per_month", True),
)


def head_to_head(production: DataFrame, challenger: DataFrame) -> DataFrame:
    """Q07: (session_id, dimension, metric, production, challenger, difference, verdict), a row
    for each of HEAD_TO_HEAD. Both sides hold session_id and columns of these names (flags as
    booleans); what a side lacks is unknown, and so is everything where no challenger ran."""
    numbers = lambda df, name: df.select("session_id", *((F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(m) for _, m, _ in HEAD_TO_HEAD)).unpivot(["session_id"], [m for _, m, _ in HEAD_TO_HEAD], "metric", name)
    both = numbers(production, "production").join(numbers(challenger, "challenger"), ["session_id", "metric"], "left")
    p, c = F.col("production"), F.col("challenger")
    dimension = F.coalesce(*(F.when(F.col("metric") == m, d) for d, m, _ in HEAD_TO_HEAD))
    less = F.col("metric").isin(*(m for _, m, lower in HEAD_TO_HEAD if lower))
    said = F.when(less, verdict(p, c)).otherwise(verdict(p, c, lower_better=False))
    return both.select("session_id", dimension.alias("dimension"), "metric", p, c, F.round(c - p, 6).alias("difference"), said.alias("verdict"))
