"""Challenger transcripts: commits claimed by turns, segments put on one clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions.scalars import delta
from callmetrics.operators.intervals import overlaps

# Fixed values of the measurement contract.
EARLY_MS, LATE_MS, GRACE_MS, RECEIPT_MS = 400, 1500, 2000, 3000
COMMIT_RECEIPTS = ("committed_transcript_with_timestamps", "committed_transcript", "final_transcript_with_timestamps", "final_transcript")
#: Cells in which turns meet commits and receipts.
CELL_MS = 60_000


def _candidates(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of a turn (low_ms to high_ms, both inside) and a mark (mark_id, mark_ms) of its call."""
    windows = turns.withColumn("l_id", F.col("turn_id")).withColumn("l_from", F.col("low_ms")).withColumn("l_to", F.col("high_ms") + 1)
    points = marks.withColumn("r_id", F.col("mark_id")).withColumn("r_from", F.floor("mark_ms")).withColumn("r_to", F.floor("mark_ms") + 1)
    return overlaps(windows, points, ["session_id"], CELL_MS).filter("mark_ms >= low_ms and mark_ms <= high_ms").drop("l_id", "l_from", "l_to", "r_id", "r_from", "r_to", "overlap_ms")


def claimed_marks(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """(session_id, turn_id, mark_id): turns in order of start each claim the first unclaimed
    mark, by mark_id, of those between their low_ms and high_ms.

    Candidates come from a join in time cells. Claims depend on each other only where
    windows of a call run into each other, so each such run of turns is settled by itself.
    """
    reach = F.max("high_ms").over(Window.partitionBy("session_id").orderBy("low_ms", "turn_id").rowsBetween(Window.unboundedPreceding, -1))
    new = turns.withColumn("__new", F.when(F.col("low_ms") <= reach, 0).otherwise(1))
    runs = new.withColumn("run", F.sum("__new").over(Window.partitionBy("session_id").orderBy("low_ms", "turn_id").rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    near = _candidates(runs, marks).select("session_id", "run", "turn_id", "start_ms", "mark_id")
    own = near.groupBy("session_id", "run", "turn_id", "start_ms").agg(F.sort_array(F.collect_list("mark_id")).alias("marks"))
    runs = own.groupBy("session_id", "run").agg(F.sort_array(F.collect_list(F.struct("start_ms", "turn_id", "marks"))).alias("turns"))  # turns that run into each other
    kinds = dict(near.dtypes)
    none = F.expr(f"cast(array() as array<struct<turn_id:{kinds['turn_id']},mark_id:{kinds['mark_id']}>>)")

    def claim(done: Column, turn: Column) -> Column:
        free = F.filter(turn["marks"], lambda m: ~F.array_contains(done["mark_id"], m))
        return F.when(F.size(free) > 0, F.concat(done, F.array(F.struct(turn["turn_id"].alias("turn_id"), F.get(free, F.lit(0)).alias("mark_id"))))).otherwise(done)

    return runs.select("session_id", F.inline(F.aggregate("turns", none, claim)))


def claimed_commits(turns: DataFrame, commits: DataFrame) -> DataFrame:
    """Turns (start_ms, end_ms) and the commits (commit_id, audio_end_ms, at_ms) they claim:
    the first whose audio ends from EARLY_MS before the turn's start to LATE_MS after its end."""
    wide = turns.withColumn("low_ms", F.col("start_ms") - EARLY_MS).withColumn("high_ms", F.col("end_ms") + LATE_MS)
    found = claimed_marks(wide, commits.select("session_id", F.col("commit_id").alias("mark_id"), F.col("audio_end_ms").alias("mark_ms")).filter("mark_ms is not null"))
    return found.withColumnRenamed("mark_id", "commit_id").join(commits.select("session_id", "commit_id", "at_ms"), ["session_id", "commit_id"])


def stream_latency(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """By turn, what a paced replay's receipts say of it.

    ``windows`` holds session_id, turn_id, start_ms, end_ms, onset_ms and onset_reliable;
    ``runs`` one row a session with ``timing`` {receipts, commits}. A turn's final is the
    commit it claims; where a run has no commits at all, a commit receipt from the turn's
    start to RECEIPT_MS after its end. Partials count up to the final, or GRACE_MS after
    the end of speech without one; the first is one whose text differs from the partial
    before it. Sessions without receipts give no rows; a turn without a window says so.
    """
    told = runs.filter(F.size("timing.receipts") > 0)
    with_text = lambda x: x["at_ms"].isNotNull() & (F.coalesce(F.trim(x["text"]), F.lit("")) != "")
    received = told.select("session_id", F.posexplode("timing.receipts").alias("seq", "r")).filter(with_text(F.col("r"))).select("session_id", "seq", F.col("r.kind").alias("kind"), F.col("r.at_ms").alias("at_ms"), F.trim("r.text").alias("text"), (F.col("r.audio_cursor_ms") - F.col("r.result_audio_end_ms")).alias("lag_ms"))
    is_partial = F.col("kind") == "partial_transcript"
    finals = received.filter(F.col("kind").isin(*COMMIT_RECEIPTS))
    committed = F.coalesce(F.size("timing.commits"), F.lit(0)) > 0
    commits = told.select("session_id", F.posexplode("timing.commits").alias("mark_id", "c")).select("session_id", "mark_id", F.col("c.audio_end_ms").alias("mark_ms"), F.col("c.at_ms").alias("at_ms"), F.col("c.audio_end_ms").alias("audio_end_ms"), F.trim("c.text").alias("text"))
    bare = told.filter(~committed).select("session_id")
    receipts = finals.join(bare, "session_id", "left_semi").select("session_id", F.col("seq").alias("mark_id"), F.col("at_ms").alias("mark_ms"), "at_ms", F.lit(None).cast("long").alias("audio_end_ms"), "text")
    marks = commits.unionByName(receipts).filter("mark_ms is not null")
    turns = windows.join(told.select("session_id", committed.alias("committed")), "session_id")
    whole = turns.filter("start_ms is not null and end_ms is not null")
    reach = whole.withColumn("low_ms", F.when(F.col("committed"), F.col("start_ms") - EARLY_MS).otherwise(F.col("start_ms"))).withColumn("high_ms", F.col("end_ms") + F.when(F.col("committed"), LATE_MS).otherwise(RECEIPT_MS))
    claims = claimed_marks(reach, marks).join(marks, ["session_id", "mark_id"]).select("session_id", "turn_id", F.col("at_ms").alias("final_at_ms"), "audio_end_ms", F.nullif("text", F.lit("")).alias("transcript"))
    ended = whole.join(claims, ["session_id", "turn_id"], "left").withColumn("upper_ms", F.coalesce("final_at_ms", F.col("end_ms") + GRACE_MS))
    before = F.lag("text").over(Window.partitionBy("session_id").orderBy("seq"))
    partials = received.filter(is_partial).withColumn("changed", F.col("text") != F.coalesce(before, F.lit(""))).select("session_id", F.col("seq").alias("mark_id"), F.col("at_ms").alias("mark_ms"), "changed", "lag_ms")
    heard = _candidates(ended.withColumn("low_ms", F.col("start_ms")).withColumn("high_ms", F.col("upper_ms")), partials).groupBy("session_id", "turn_id").agg(
        F.count("*").alias("partial_count"), F.min_by("mark_ms", F.when(F.col("changed"), F.col("mark_id"))).alias("first_partial_at_ms"), F.bround(F.avg("lag_ms")).cast("long").alias("streaming_cursor_lag_ms"),
    )
    any_receipt = received.filter(is_partial | F.col("kind").isin(*COMMIT_RECEIPTS)).select("session_id", F.col("seq").alias("mark_id"), F.col("at_ms").alias("mark_ms"))
    after = _candidates(ended.withColumn("low_ms", F.col("end_ms")).withColumn("high_ms", F.col("upper_ms")), any_receipt).groupBy("session_id", "turn_id").agg(F.min("mark_ms").alias("after_ms"))
    found = ended.join(heard, ["session_id", "turn_id"], "left").join(after, ["session_id", "turn_id"], "left")
    measured = found.select(
        "session_id", "turn_id", F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), "first_partial_at_ms", F.when(F.col("onset_reliable"), delta(F.col("first_partial_at_ms"), F.col("onset_ms"))).alias("time_to_first_partial_ms"),
        F.when(~F.col("onset_reliable"), "no_reliable_speech_onset").alias("first_partial_unmeasurable_reason"), "final_at_ms", delta(F.col("final_at_ms"), F.col("end_ms")).alias("endpoint_delay_ms"),
        delta(F.col("audio_end_ms"), F.col("end_ms"), True).alias("endpoint_position_error_ms"), delta(F.col("after_ms"), F.col("end_ms")).alias("post_end_delay_ms"), F.coalesce("partial_count", F.lit(0)).alias("partial_count"),
        "streaming_cursor_lag_ms", "transcript", F.col("final_at_ms").isNull().alias("missing_final"),
    )
    blind = turns.filter("start_ms is null or end_ms is null").select("session_id", "turn_id", F.lit(False).alias("available"), F.lit("no_speech_window").alias("reason"))
    return measured.unionByName(blind, allowMissingColumns=True)


def first_changed_partial(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest hypothesis that differs from the one before it."""
    before = F.lag("text").over(Window.partitionBy(*keys).orderBy("at_ms", "seq"))
    changed = partials.withColumn("__before", before).filter(~F.col("text").eqNullSafe(F.col("__before")) & (F.col("text") != ""))
    return changed.groupBy(*keys).agg(F.min_by("text", F.struct("at_ms", "seq")).alias("text"), F.min("at_ms").alias("at_ms"))


def rebased_segments(segments: Column, silence_ms: int = 0) -> Column:
    """Segments {start_ms, end_ms, cursor_ms} whose clocks restart, on the call's
    clock: each begins no earlier than the one before it ended, nor than the audio cursor
    less its own length and the silence after it."""
    start = F.struct(F.lit(0.0).alias("until"), F.expr("cast(array() as array<struct<start_ms:double,end_ms:double>>)").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        restarted = x["start_ms"] < acc["until"]
        offset = F.when(restarted, F.greatest(acc["until"], x["cursor_ms"] - x["end_ms"] - silence_ms)).otherwise(F.lit(0.0))
        moved = F.struct((x["start_ms"] + offset).alias("start_ms"), (x["end_ms"] + offset).alias("end_ms"))
        return F.struct((x["end_ms"] + offset).alias("until"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.aggregate(segments, start, place, lambda acc: acc["out"])


def selected_run(runs: DataFrame) -> DataFrame:
    """Of each session's complete runs: streaming with words, any with words, streaming, any; then the newest."""
    words = F.coalesce(F.size(F.filter("words", lambda w: w["type"] == "word")), F.lit(0)) > 0
    streaming = F.col("kind") == "streaming"
    rank = F.when(streaming & words, 0).when(words, 1).when(streaming, 2).otherwise(3)
    order = Window.partitionBy("session_id").orderBy(rank, F.col("created_at").desc_nulls_last())
    return runs.filter("status = 'complete'").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def peaks(frames: DataFrame, bucket_frames: int) -> DataFrame:
    """Greatest magnitude of each bucket of 16-bit PCM blocks (path, first_frame,
    content), scaled to 0..1000; a file's blocks may lie in any tasks."""
    import numpy as np

    def scan(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            for path, first, content in zip(part["path"], part["first_frame"], part["content"], strict=True):
                pcm = np.abs(np.frombuffer(content[: len(content) // 2 * 2], "<i2").astype(np.int32))
                bucket = (first + np.arange(len(pcm))) // bucket_frames
                top = pd.Series(pcm).groupby(bucket).max()
                yield pd.DataFrame({"path": path, "bucket": top.index, "peak": top.to_numpy()})

    found = frames.mapInPandas(scan, "path string, bucket long, peak long")
    return found.groupBy("path", "bucket").agg(F.max("peak").alias("peak")).withColumn("level", F.bround(F.col("peak") * 1000 / 32767).cast("int"))


def downsampled(levels: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """Coarser peaks: the greatest of the fine buckets that each covers."""
    return levels.groupBy(*keys, F.floor(F.col("bucket") / factor).alias("bucket")).agg(F.max("level").alias("level"))
