"""Session packages (manifest.json, events.jsonl, challenger runs, objects) as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmetrics.sources.shared import checkpointed

MANIFEST = """schema_version string, session_id string, agent_id string, started_at string, duration_ms bigint, outcome string,
sdk struct<name:string,language:string,version:string>, metadata map<string,string>,
capture_status struct<events_complete:boolean,audio_complete:boolean,coverage_complete:boolean,dropped_event_count:bigint,dropped_audio_chunk_count:bigint,
coverage_gaps:array<struct<stage:string,reason:string,turn_ids:array<string>>>>, audio map<string,struct<file:string,encoding:string,sample_rate_hz:int,channels:int>>"""
OPERATION = """kind string, event_id string, session_id string, turn_id string, scope string, type string, endpoint_id string, provider string, model string, transport string,
started_at_ms bigint, ended_at_ms bigint, duration_ms bigint, status string, error struct<name:string,message:string>,
request struct<name:string,model:string,endpointing_ms:double,utterance_end_ms:double,interim_results:boolean,vad_events:boolean,sample_rate_hz:int,derived_from:string,body:string>,
response struct<transcript:string,text:string,char_count:bigint,confidence:double,language:string,final_reason:string,
words:array<struct<text:string,type:string,start_ms:double,end_ms:double,start:double,end:double>>,prompt_tokens:bigint,completion_tokens:bigint,input_tokens:bigint,output_tokens:bigint,
total_tokens:bigint,ttft_ms:double,audio_ms:double,continues_turn:string,reply_attribution:string,reply_skipped:string,body:string,close_code:int,sent_bytes:bigint,status:int>,
milestones map<string,struct<occurred_at_ms:double,last_at_ms:double,count:int,transcription_delay_ms:double>>,
samples map<string,struct<items:array<struct<occurred_at_ms:double,transcript:string>>,truncated:boolean>>"""
AUDIO_CHUNK = "kind string, session_id string, track string, occurred_at_ms double, playout_at_ms double, byte_length bigint, duration_ms double, operation_id string, turn_id string"
RUN = """schema_version string, session_id string, created_at string, provider string, model string, kind string, status string, error string,
audio struct<track:string,sample_rate_hz:int,channels:int,duration_secs:double>,
response struct<text:string,language_code:string,words:array<struct<text:string,type:string,start_ms:double,end_ms:double,start:double,end:double,logprob:double>>>,
timing struct<wall_clock_ms:bigint,receipts:array<struct<kind:string,at_ms:bigint,audio_cursor_ms:bigint,text:string,result_audio_end_ms:bigint>>,
commits:array<struct<at_ms:bigint,text:string,audio_start_ms:bigint,audio_end_ms:bigint>>>, usage struct<audio_seconds:double,billable_minutes:double,request_count:int>"""
STAGES = ("stt", "llm", "tts", "tool")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(package, value): the lines of event logs, and the folder each lies in."""
    return spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("package"), "value")


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """``parsed``: the line by ``schema``, values of other kinds NULL; ``whole``: it is a JSON object."""
    rows = lines.filter(F.trim("value") != "")
    probe = F.from_json("value", "__none string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("parsed", F.from_json("value", schema)).withColumn("whole", probe["_corrupt"].isNull())


def _is_span(op: Column, package: Column) -> Column:
    return op["type"].isin(*STAGES) & op["event_id"].isNotNull() & (op["session_id"] == package)


def opened_lines(lines: DataFrame) -> DataFrame:
    """(package, op, text, whole): lines of (package, value): ``op`` is NULL unless the line is
    a span, ``text`` unless its kind says that it is an audio chunk (see chunk_of). A line is
    parsed as an operation once, and looked at again only if a value of it did not fit. No
    row is filtered by what was parsed: a filter would parse it again."""
    fits = F.from_json("value", f"{OPERATION}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    probe = F.from_json("value", "__none string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    told = lines.filter(F.trim("value") != "").select("package", "value", fits.alias("fits"))
    op = F.when(_is_span(F.col("fits"), F.col("package")), F.col("fits").dropFields("_corrupt"))
    text = F.when(F.col("fits.kind") == "audio_chunk", F.col("value"))
    return told.select("package", op.alias("op"), text.alias("text"), F.when(F.col("fits._corrupt").isNull(), True).otherwise(probe["_corrupt"].isNull()).alias("whole"))


def chunk_of(text: Column) -> Column:
    return F.from_json(text, AUDIO_CHUNK)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(package, op, chunk, whole): lines of (package, value) by both schemas: ``op`` is NULL
    unless the line is a span, ``chunk`` unless it is an audio chunk."""
    return opened_lines(lines).select("package", "op", chunk_of(F.col("text")).alias("chunk"), "whole")


def rejected_in(parsed: DataFrame) -> DataFrame:
    """Packages that a line of parsed_lines() rejects."""
    return parsed.filter("not whole").select("package").distinct()


def operations_in(parsed: DataFrame, rejected: DataFrame) -> DataFrame:
    """operations_of() of lines that are parsed."""
    spans = parsed.filter(_is_span(F.col("op"), F.col("package")))
    return spans.join(rejected, "package", "left_anti").select("op.*").drop("kind")


def audio_chunks_in(parsed: DataFrame) -> DataFrame:
    """audio_chunks_of() of lines that are parsed."""
    return parsed.filter("chunk.kind = 'audio_chunk'").select("chunk.*").drop("kind")


def operations_of(lines: DataFrame) -> DataFrame:
    """Spans of known stages with an id, of the package's own session, from lines of
    (package, value). A line that is no JSON object rejects its whole package (see
    rejected_packages)."""
    parsed = checkpointed(parsed_lines(lines))
    return operations_in(parsed, checkpointed(rejected_in(parsed)))


def read_operations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return operations_of(read_lines(spark, paths))


def rejected_packages(lines: DataFrame) -> DataFrame:
    """(package, bad_lines) of packages that operations_of() leaves out."""
    return _parsed(lines, "kind string").filter("not whole").groupBy("package").agg(F.count("*").alias("bad_lines"))


def audio_chunks_of(lines: DataFrame) -> DataFrame:
    """Audio-chunk events; lines that cannot be read are passed over."""
    return _parsed(lines, AUDIO_CHUNK).filter("parsed.kind = 'audio_chunk'").select("parsed.*").drop("kind")


def read_audio_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return audio_chunks_of(read_lines(spark, paths))


def manifests_of(rows: DataFrame) -> DataFrame:
    """Typed manifests; outcome defaults to 'unknown', missing maps to empty ones."""
    empty = F.expr("map()").cast("map<string,string>")
    return rows.withColumn("outcome", F.coalesce("outcome", F.lit("unknown"))).withColumn("metadata", F.coalesce("metadata", empty))


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return manifests_of(spark.read.schema(MANIFEST).json(paths, multiLine=True))


def runs_of(rows: DataFrame) -> DataFrame:
    """Runs with what they need, words in ms, version 1.0 as 2.0, newest first for each session."""
    rows = rows.filter("session_id is not null and model is not null and status is not null")
    ms = lambda w, n: F.coalesce(w[f"{n}_ms"], F.bround(w[n] * 1000))
    words = F.transform("response.words", lambda w: F.struct(w["text"].alias("text"), F.coalesce(w["type"], F.lit("word")).alias("type"), ms(w, "start").alias("start_ms"), ms(w, "end").alias("end_ms"), w["logprob"].alias("logprob")))
    rows = rows.withColumn("words", words).withColumn("kind", F.coalesce("kind", F.lit("batch"))).withColumn("schema_version", F.lit("2.0"))
    return rows.withColumn("recency", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("created_at").desc_nulls_last(), "model")))


def read_challenger_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return runs_of(spark.read.schema(RUN).json(paths, multiLine=True))


def verify_objects(objects: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared (path, bytes, sha256) that the files (path, length, content) do not match."""
    have = objects.select("path", F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    joined = declared.join(have, "path", "left")
    reason = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("found_bytes") != F.col("bytes"), "size").when(F.col("found_sha256") != F.lower("sha256"), "checksum")
    return joined.withColumn("reason", reason).filter("reason is not null").select("path", "reason", "found_bytes")


def recordings_inventory(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Each declared track with the size of its file (session_id, file, length), or NULL."""
    tracks = manifests.select("session_id", F.explode("audio").alias("track", "spec")).select("session_id", "track", F.col("spec.file").alias("file"))
    return tracks.join(files.select("session_id", "file", F.col("length").alias("bytes")), ["session_id", "file"], "left").withColumn("present", F.col("bytes").isNotNull())


def overlaid(defaults: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Rows of ``defaults`` with each value that ``override`` has in its place."""
    values = [c for c in defaults.columns if c != key]
    d, o = defaults.alias("d"), override.alias("o")
    return d.join(o, key, "full").select(key, *(F.coalesce(f"o.{c}", f"d.{c}").alias(c) for c in values))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of every old row that shares its keys, so that a call with
    fewer turns than before leaves none behind."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that ``df`` has rows for."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def day_of(at_ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(at_ms))
