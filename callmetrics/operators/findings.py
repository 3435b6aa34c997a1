"""Published figures held against a second way of finding them, in long form.

A finding is (session_id, turn_id, category, field, expected, actual). Categories:
``evidence`` (a value differs from what the capture shows), ``absence`` (a value where the
capture shows none), ``aggregate`` (a statistic differs from its samples) and ``invariant``
(a rule that must always hold does not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.spans import FORCED_FLUSH_REASONS, SPEECH_END, SPEECH_START, WORD_CLOCK_TOLERANCE_MS

TOLERANCE_MS = 0.51
TIMINGS = ("speech_start_ms", "speech_end_ms", "time_to_first_partial_ms", "endpoint_delay_ms", "final_from_last_word_ms", "endpoint_position_error_ms", "missing_final", "forced_flush")


def _observed(*names: str) -> Column:
    return F.coalesce(*(F.bround(F.col("milestones")[n]["occurred_at_ms"]) for n in names))


def second_timings(stt: DataFrame) -> DataFrame:
    """(session_id, turn_id, and TIMINGS as doubles) of recognitions, from their captured
    spans alone and by steps of its own: words, then repeated finals, then gaps."""
    repeats = [F.col("milestones")[n] for n in ("final_transcript", "speech_final")]
    late = F.greatest(*(F.when((m["count"] >= 2) & (m["last_at_ms"] > m["occurred_at_ms"]), F.bround(m["last_at_ms"])) for m in repeats))
    delay = F.col("milestones")["end_of_utterance"]["transcription_delay_ms"]
    spoken = F.filter("response.words", lambda w: F.coalesce(w["type"] == "word", F.lit(True)))
    step = stt.select(
        "session_id", "turn_id", F.array_min(F.transform(spoken, lambda w: w["start_ms"])).alias("word_from"), F.array_max(F.transform(spoken, lambda w: w["end_ms"])).alias("word_to"),
        F.coalesce(_observed(*SPEECH_START), F.col("started_at_ms").cast("double")).alias("listened"), _observed(*SPEECH_END).alias("paused"), F.col("ended_at_ms").cast("double").alias("ended"), late.alias("late"), delay.alias("delay"),
        _observed("first_partial").alias("partial"), _observed("final_transcript").alias("own_final"), _observed("final_transcript", "speech_final").alias("any_final"), F.col("response.final_reason").alias("reason"), F.when(F.size("response.words") > 0, F.lit(True)).alias("words"),
    )
    step = step.withColumn("word_from", F.when(F.col("word_from") >= F.col("listened") - WORD_CLOCK_TOLERANCE_MS, F.bround("word_from"))).withColumn("word_to", F.bround("word_to"))
    until = F.least(F.col("late") - F.coalesce("delay", F.lit(0.0)), F.col("ended"))
    step = step.withColumn("declared", F.coalesce("paused", "ended")).withColumn("declared", F.when(F.col("late").isNotNull() & (F.col("declared").isNull() | (until > F.col("declared"))), F.bround(until)).otherwise(F.col("declared")))
    step = step.withColumn("closed", F.coalesce("late", "any_final")).withColumn("onset", F.coalesce("word_from", "listened")).withColumn("finish", F.coalesce("word_to", "declared"))
    ahead = lambda later, earlier: F.when(F.col(later) >= F.col(earlier), F.col(later) - F.col(earlier))
    apart = F.when(F.col("closed") != F.col("declared"), ahead("closed", "declared"))
    worded = F.col("word_from").isNotNull() & F.col("word_to").isNotNull()
    told = {
        "speech_start_ms": F.col("onset"), "speech_end_ms": F.col("finish"), "time_to_first_partial_ms": F.when(F.col("partial") != F.col("onset"), ahead("partial", "onset")), "endpoint_delay_ms": F.when(F.col("own_final").isNotNull() & F.col("paused").isNotNull(), F.coalesce(apart, F.bround("delay"))),
        "final_from_last_word_ms": F.when(worded, ahead("closed", "word_to")), "endpoint_position_error_ms": F.when(F.col("paused").isNotNull() & F.col("words").isNotNull(), F.col("declared") - F.col("finish")),
        "missing_final": F.col("closed").isNull(), "forced_flush": F.coalesce(F.col("reason").isin(*FORCED_FLUSH_REASONS), F.lit(False)),
    }
    return step.select("session_id", "turn_id", *(v.cast("double").alias(k) for k, v in told.items()))


def compared(published: DataFrame, expected: DataFrame, fields: tuple[str, ...], keys: tuple[str, ...] = ("session_id", "turn_id")) -> DataFrame:
    """Differences of numeric ``fields`` beyond the tolerance: evidence where the capture shows
    another value or one that is not published, absence where it shows none. A key that
    only one side has is an invariant broken."""
    long = lambda df, name: df.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(list(keys), list(fields), "field", name)
    here = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = here(published, "__p").join(here(expected, "__e"), list(keys), "full")
    lost = both.filter("__p is null or __e is null").select(*keys, F.lit("invariant").alias("category"), F.lit("turn").alias("field"), F.col("__e").cast("double").alias("expected"), F.col("__p").cast("double").alias("actual"))
    joined = long(published, "actual").join(long(expected, "expected"), [*keys, "field"])
    apart = F.col("expected").isNull() != F.col("actual").isNull()
    wrong = joined.filter(apart | (F.abs(F.col("expected") - F.col("actual")) > TOLERANCE_MS))
    category = F.when(F.col("expected").isNull(), "absence").otherwise("evidence")
    return wrong.select(*keys, category.alias("category"), "field", "expected", "actual").unionByName(lost)


def aggregates(stated: DataFrame, samples: DataFrame, metric: str, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Stated blocks (keys, count, p50, p90, p95, min, max, mean) against ``samples`` of
    ``metric``: ranks taken from sorted samples of each key, interpolated between neighbours."""
    own = samples.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(metric).cast("double"))).alias("x"))  # one call's samples
    n = F.size("x")

    def at(p: float) -> Column:
        place = (n - 1) * F.lit(p)
        low = F.floor(place).cast("int")
        a, b = F.get("x", low), F.get("x", F.least(low + 1, n - 1))
        return a + (b - a) * (place - low)

    again = own.select(
        *keys, n.cast("double").alias("count"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), F.get("x", F.lit(0)).alias("min"), F.get("x", n - 1).alias("max"), (F.aggregate("x", F.lit(0.0), lambda t, v: t + v) / n).alias("mean")
    )
    names = ("count", "p50", "p90", "p95", "min", "max", "mean")
    zero = stated.select(*keys).distinct().join(again, list(keys), "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    found = compared(stated, zero, names, keys)
    return found.withColumn("category", F.when(F.col("category") == "evidence", "aggregate").otherwise(F.col("category"))).withColumn("field", F.concat(F.lit(f"{metric}."), "field"))


#: Rules of turn facts that must always hold, by what breaks them.
INVARIANTS = {
    "negative_duration": "duration_ms < 0", "reply_below_minimum": "response_ms < 250",
    **{f"{s}_failed_above_ops": f"{s}_failed > {s}_ops" for s in ("stt", "llm", "tts", "tool")}, "interrupted_above_ops": "tts_interrupted > tts_ops",
    "partial_measured_and_explained": "stt_first_partial_ms is not null and stt_first_partial_unmeasurable_reason is not null", "endpoint_measured_and_explained": "stt_endpoint_delay_ms is not null and stt_endpoint_unmeasurable_reason is not null",
    "endpoint_neither_measured_nor_explained": "stt_ops > 0 and stt_endpoint_delay_ms is null and stt_endpoint_unmeasurable_reason is null", "negative_latency": "least(stt_first_partial_ms, stt_endpoint_delay_ms, stt_final_ms, llm_ttft_ms, tts_first_audio_ms, tts_synthesis_ms) < 0",
    "continues_itself": "continues_turn = turn_id", "split_on_a_continuation": "is_continuation and (stt_split or llm_split or tts_split or tool_split)", "continuation_of_nothing": "is_continuation and continues_turn is null", "ended_before_start": "ended_at_ms < started_at_ms",
}


def invariants(turns: DataFrame) -> DataFrame:
    """One finding for each rule that a turn breaks."""
    broken = F.array_compact(F.array(*(F.when(F.expr(when), F.lit(name)) for name, when in INVARIANTS.items())))
    none = F.lit(None).cast("double")
    return turns.select("session_id", "turn_id", F.lit("invariant").alias("category"), F.explode(broken).alias("field"), none.alias("expected"), none.alias("actual"))
