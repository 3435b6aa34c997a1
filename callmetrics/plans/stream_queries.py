"""Streaming operators driven to the end of the bound tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callmetrics.operators import facts, rollups as tiers
from callmetrics.plans.dashboard_queries import _FAULTS, _INTERVALS, _TOOLS, FLAT, PACKAGE, _flat, _visible
from callmetrics.plans.registry import FACTS, query
from callmetrics.plans.scalar_queries import turns_of
from callmetrics.sources import nested
from callmetrics.sources.binding import table
from callmetrics.sources.packages import write_partitions
from callmetrics.sources.shared import shared_path
from callmetrics.streaming import rollups
from callmetrics.streaming.rollups import Facts, FactStore, Inbox


def _fresh(spark, name: str) -> str:
    return f"{shared_path(spark)}/{name}-{uuid.uuid4().hex}"


@query("E01_incremental_rollup", PACKAGE + _INTERVALS)
def e01(spark, d):
    """Event lines and manifests of packages, in micro-batches that deal them differently:
    lines wait for their manifest, and packages whose lines come later are taken again."""
    base = _fresh(spark, "e01")
    lines = nested.lines(spark, d).select(F.lit("line").alias("kind"), "package", "value")
    told = nested.manifest_lines(spark, d).select(F.lit("manifest").alias("kind"), "package", "value")
    lines.repartition(2, "package").write.parquet(f"{base}/lines")
    told.repartition(2, F.hash("package") % 7).write.parquet(f"{base}/manifests")
    read = lambda name: spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
    store = FactStore(spark, f"{base}/store")
    rollups.follow(read("lines").union(read("manifests")), Inbox(spark, f"{base}/inbox", store).take, f"{base}/progress")
    return _visible(store.tier("intervals"))


def _late(spark, d) -> FactStore:
    """Calls of one agent first arrive two days late and are uploaded again as they were."""
    turns, calls, tools, failures = _flat(spark, d)
    shift = lambda df: df.withColumn("started_ms", F.col("started_ms") + 172_800_000)
    of = lambda when: [df.filter(when) for df in (turns, calls)] + [tools.join(turns.filter(when).select("session_id", "turn_id"), ["session_id", "turn_id"], "left_semi"), failures.filter(when)]
    store = FactStore(spark, _fresh(spark, "e02"))
    late = of("agent_id = 'agent-3'")
    store.refresh(Facts.of(*of("agent_id <> 'agent-3'")))
    store.refresh(Facts.of(shift(late[0]), shift(late[1]), late[2], shift(late[3])))
    store.refresh(Facts.of(*late))
    return store


@query("E02_late_reupload", FLAT + _INTERVALS)
def e02(spark, d):
    return _visible(_late(spark, d).tier("intervals"))


@query("E02_late_tools", FLAT + _TOOLS)
def e02_tools(spark, d):
    """The tool tier after the same, from a compacted store."""
    return _visible(_late(spark, d).compact().tier("tools"))


@query("E02_late_failures", FLAT + _FAULTS)
def e02_failures(spark, d):
    return _visible(_late(spark, d).tier("failures"))


@query("E05_pending_counters", FACTS + "select count(*) filter (n is null) as unbuilt, count(*) filter (n < turns) as stale from calls left join (select session_id as s, count(*) as n from turns where agent_id <> 'agent-5' and status <> 'error' group by 1) b on s = session_id")
def e05(spark, d):
    turns = turns_of(spark, d)
    built = turns.filter("agent_id <> 'agent-5' and status <> 'error'").groupBy("session_id").agg(F.count("*").alias("n"))
    return facts.call_facts(turns).join(built, "session_id", "left").agg(F.count_if(F.col("n").isNull()).alias("unbuilt"), F.count_if(F.col("n") < F.col("turns")).alias("stale"))


_KEYS = f"""keys as (select agent_id, started_ms // 3600000 * 3600000 as bucket_ms from turns union select agent_id, started_ms // 3600000 * 3600000 from calls union select agent_id, started_ms // 3600000 * 3600000 from ff), spread as (select * from keys union select '__all__', bucket_ms from keys)"""


@query("U01_dirty_buckets", FLAT + ", " + _KEYS + " select bucket_ms, agent_id from spread order by bucket_ms, agent_id offset 100")
def u01(spark, d):
    """Keys still dirty after one bounded pass, oldest first, over all calls."""
    store = FactStore(spark, _fresh(spark, "u01"))
    store.add(Facts.of(*_flat(spark, d)))
    store.rebuild(limit=100)
    return store.pending().select("bucket_ms", "agent_id")


@query("E06_windowed_counts", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2 having window_start + interval '1 hour' <= (select max(ts) - interval '1 day' from events)")
def e06(spark, d):
    """Windows that the watermark, a day behind the newest event, has closed."""
    base = _fresh(spark, "e06")
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parq*et").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = rollups.windowed_counts(events, "event_id", "ts", "event_type")
    found = rollups.collected(counts, f"{base}/progress", f"{base}/windows")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("S07_write_rollups", FLAT + f"select * from ({_INTERVALS}) r where agent_id = 'agent-1'")
def s07(spark, d):
    base = _fresh(spark, "s07")
    turns, calls, *_ = _flat(spark, d)
    rolled = _visible(tiers.interval_rollup(turns, calls))
    write_partitions(rolled, base, ["agent_id"])
    return spark.read.parquet(base).filter("agent_id = 'agent-1'").select(*rolled.columns)
