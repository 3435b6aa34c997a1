"""Tiers kept fresh as calls arrive.

Arrivals replace the facts of their calls. The (hour, agent) keys that those calls occupied
before or occupy now are marked dirty, and only they are built anew, from facts, in all
tiers; nothing is incremented, so late and repeated uploads are right without a
watermark. Every step only adds files of its own version, so one that runs again after
a failure ends in the same state. Unbounded logs without calls have the windowed form
with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmetrics.functions.scalars import bucket_floor
from callmetrics.operators import calls as packaged
from callmetrics.operators import rollups
from callmetrics.operators.measures import ALL_AGENTS, HOUR_MS
from callmetrics.sources.packages import MANIFEST, audio_chunks_in, day_of, manifests_of, operations_in, parsed_lines, rejected_in
from callmetrics.sources.shared import checkpointed

#: Parts that sessions are dealt to, so that an arrival reads only its own parts of the index.
SLOTS = 16


def slot_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(SLOTS)).cast("int")


@dataclass(frozen=True)
class Facts:
    """Facts of some calls: all there are of each call. Tools lie at their turn's start
    (rollups.in_turns()). ``sessions`` names the calls, those without any fact too."""

    turns: DataFrame
    calls: DataFrame
    tools: DataFrame
    failures: DataFrame
    sessions: DataFrame

    KINDS = ("turns", "calls", "tools", "failures")

    @staticmethod
    def of(turns: DataFrame, calls: DataFrame, tools: DataFrame, failures: DataFrame, sessions: DataFrame | None = None) -> Facts:
        named = turns.select("session_id").union(calls.select("session_id")).distinct() if sessions is None else sessions
        return Facts(turns, calls, rollups.in_turns(tools, turns), failures, named)


class FactStore:
    """Facts by day and version, an index of which call occupies which hours, what later
    versions replaced, dirty keys and what was built of them, under one folder.

    A fact counts unless ``gone`` names its call and version; a tier's row counts if it was
    built by the last pass over its key. Of the history, an arrival reads its sessions'
    slots of the index, and a pass the days of its keys. ``compact`` writes what counts
    into a new generation.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, path
        found = self._read(f"{path}/generations", "generation int").agg(F.max("generation")).first()[0]
        self.path = f"{path}/g{found or 0}"
        self.generation = found or 0

    def _read(self, path: str, schema: str | T.StructType) -> DataFrame:
        """The table, or no rows before the first write."""
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        try:
            return self.spark.read.schema(kind).parquet(path)
        except Exception as error:  # an absent path is only known by the reader's error
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], kind)

    def _index(self) -> DataFrame:
        return self._read(f"{self.path}/index", "session_id string, bucket_ms bigint, agent_id string, slot int, version int")

    def _dirty(self) -> DataFrame:
        return self._read(f"{self.path}/dirty", "bucket_ms bigint, agent_id string, version int")

    def _done(self) -> DataFrame:
        return self._read(f"{self.path}/done", "bucket_ms bigint, agent_id string, upto int, pass int")

    @staticmethod
    def _write(df: DataFrame, path: str, by: list[str], dealt: bool = True) -> None:
        """Replaces the partitions that ``df`` has rows for, so a version that is written again stays one.
        ``dealt``: one task writes each; else all tasks that have rows of it do, as a large one needs."""
        (df.repartition(*by) if dealt else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def add(self, arrived: Facts, version: int | None = None) -> None:
        """Replace all facts of the calls in ``arrived`` and mark the keys they touch.
        ``version`` numbers arrivals in order; one that runs again ends in the same state."""
        if version is None:
            version = 1 + (self._dirty().agg(F.max("version")).first()[0] or 0)
        at = F.lit(version)
        held, sessions = {}, checkpointed(arrived.sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct())
        for kind in Facts.KINDS:
            rows = getattr(arrived, kind).withColumn("session_id", F.col("session_id").cast("string")).withColumn("day", day_of(F.col("started_ms"))).withColumn("version", at)
            self._write(rows, f"{self.path}/facts/{kind}", ["day", "version"])
            held[kind] = self._read(f"{self.path}/facts/{kind}", rows.schema).filter(F.col("version") == version)
        spot = lambda df: df.filter("started_ms is not null").select("session_id", bucket_floor(F.col("started_ms"), HOUR_MS).alias("bucket_ms"), F.coalesce("agent_id", F.lit("")).alias("agent_id"))
        now = spot(held["turns"]).union(spot(held["calls"])).union(spot(held["tools"])).union(spot(held["failures"])).distinct()
        now = checkpointed(now.withColumn("slot", slot_of(F.col("session_id"))).withColumn("version", at))
        self._write(now, f"{self.path}/index", ["slot", "version"])
        slots = [r[0] for r in sessions.select(slot_of(F.col("session_id")).alias("s")).distinct().collect()]  # at most SLOTS
        before = checkpointed(self._index().filter(F.col("slot").isin(slots) & (F.col("version") < version)).join(sessions, "session_id", "left_semi"))
        gone = before.select("session_id", F.col("version").alias("replaced"), day_of(F.col("bucket_ms")).alias("day")).distinct()
        self._write(gone.withColumn("version", at), f"{self.path}/gone", ["day", "version"])
        keys = now.select("bucket_ms", "agent_id").union(before.select("bucket_ms", "agent_id"))
        keys = keys.union(keys.select("bucket_ms", F.lit(ALL_AGENTS).alias("agent_id"))).distinct()
        self._write(keys.withColumn("version", at), f"{self.path}/dirty", ["version"])

    def pending(self) -> DataFrame:
        """Dirty keys (bucket_ms, agent_id, upto): marked since they were last built."""
        marked = self._dirty().groupBy("bucket_ms", "agent_id").agg(F.max("version").alias("upto"))
        built = self._done().groupBy("bucket_ms", "agent_id").agg(F.max("upto").alias("built"))
        return marked.join(built, ["bucket_ms", "agent_id"], "left").filter("built is null or built < upto").drop("built")

    def rebuild(self, limit: int | None = None) -> None:
        """Build the pending keys anew in all tiers, the oldest first if only ``limit`` of them."""
        wanted = self.pending()
        keys = checkpointed(wanted if limit is None else wanted.orderBy("bucket_ms", "agent_id").limit(limit))
        days = [r[0] for r in keys.select(day_of(F.col("bucket_ms")).alias("d")).distinct().collect()]  # days of the keys of one pass
        if not days:
            return
        number = F.lit(1 + (self._done().agg(F.max("pass")).first()[0] or 0))
        hours = keys.select("bucket_ms").distinct()
        tiers = rollups.build_placed(*(self._counting(kind, days, hours) for kind in Facts.KINDS))
        for name in rollups.Tiers.NAMES:
            mine = getattr(tiers, name).join(keys.select("bucket_ms", "agent_id"), ["bucket_ms", "agent_id"], "left_semi")
            self._write(mine.withColumn("pass", number), f"{self.path}/tiers/{name}", ["pass"], dealt=False)
        self._write(keys.withColumn("pass", number), f"{self.path}/done", ["pass"])

    def _counting(self, kind: str, days: list | None = None, hours: DataFrame | None = None) -> DataFrame:
        """Facts that no later version replaced, of some hours or all."""
        rows = self.spark.read.parquet(f"{self.path}/facts/{kind}")
        gone = self._read(f"{self.path}/gone", "session_id string, replaced int, day date, version int")
        if days is not None:
            rows, gone = rows.filter(F.col("day").isin(days)), gone.filter(F.col("day").isin(days))
            rows = rows.withColumn("bucket_ms", bucket_floor(F.col("started_ms"), HOUR_MS)).join(hours, "bucket_ms", "left_semi").drop("bucket_ms")
        return rows.join(gone.select("session_id", "day", F.col("replaced").alias("version")).distinct(), ["session_id", "day", "version"], "left_anti")

    def refresh(self, arrived: Facts, version: int | None = None) -> None:
        """Take an arrival in and build what it touched."""
        self.add(arrived, version)
        self.rebuild()

    def tier(self, name: str) -> DataFrame:
        last = self._done().groupBy("bucket_ms", "agent_id").agg(F.max("pass").alias("pass"))
        return self.spark.read.parquet(f"{self.path}/tiers/{name}").join(last, ["bucket_ms", "agent_id", "pass"], "left_semi").drop("pass")

    def tiers(self) -> rollups.Tiers:
        return rollups.Tiers(*(self.tier(name) for name in rollups.Tiers.NAMES))

    def compact(self) -> FactStore:
        """Only what counts, in a new generation: one version of facts, one pass of tiers. Readers
        of the old one are not disturbed; the new one counts once its last row is written."""
        version = self._dirty().agg(F.max("version")).first()[0] or 0
        number = self._done().agg(F.max("pass")).first()[0] or 0
        to = f"{self.root}/g{self.generation + 1}"
        for kind in Facts.KINDS:
            self._write(self._counting(kind).withColumn("version", F.lit(version)), f"{to}/facts/{kind}", ["day", "version"])
        newest = self._index().groupBy("session_id").agg(F.max("version").alias("version"))
        self._write(self._index().join(newest, ["session_id", "version"], "left_semi").withColumn("version", F.lit(version)), f"{to}/index", ["slot", "version"])
        for name in rollups.Tiers.NAMES:
            self._write(self.tier(name).withColumn("pass", F.lit(number)), f"{to}/tiers/{name}", ["pass"], dealt=False)
        # what is pending stays so: it was marked by the last version, and built by none of that
        open_ = self.pending().select("bucket_ms", "agent_id").withColumn("open", F.lit(True))
        keys = self._dirty().select("bucket_ms", "agent_id").distinct().join(open_, ["bucket_ms", "agent_id"], "left")
        self._write(keys.select("bucket_ms", "agent_id", F.lit(version).alias("version")), f"{to}/dirty", ["version"])
        done = keys.select("bucket_ms", "agent_id", F.when(F.col("open"), version - 1).otherwise(version).alias("upto"), F.lit(number).alias("pass"))
        self._write(done, f"{to}/done", ["pass"])
        self.spark.createDataFrame([(self.generation + 1,)], "generation int").write.mode("append").parquet(f"{self.root}/generations")
        return FactStore(self.spark, self.root)


class Inbox:
    """Packages as they come in: lines of event logs wait until their manifest is there, in
    any order, and later lines or manifests make their package be taken again as a whole.
    A package with a line that cannot be read has no facts, nor those it had before."""

    def __init__(self, spark: SparkSession, path: str, store: FactStore) -> None:
        self.spark, self.path, self.store = spark, path, store

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of (kind: line or manifest, package, value)."""
        placed = batch.withColumn("slot", slot_of(F.col("package"))).withColumn("version", F.lit(number))
        FactStore._write(placed, self.path, ["slot", "version"])
        came = self.store._read(self.path, placed.schema).filter(F.col("version") == number)
        touched = came.select("package", "slot").distinct()
        slots = [r[0] for r in touched.select("slot").distinct().collect()]  # at most SLOTS
        if not slots:
            return
        held = self.store._read(self.path, came.schema).filter(F.col("slot").isin(slots) & (F.col("version") <= number)).join(touched, ["package", "slot"], "left_semi")
        told = held.filter("kind = 'manifest'").groupBy("package").agg(F.max_by("value", F.struct("version", "value")).alias("value"))
        told = checkpointed(told)
        if told.isEmpty():  # nothing that came has its manifest yet
            return
        lines = held.filter("kind = 'line'").join(told.select("package"), "package", "left_semi").select("package", "value")
        parsed = checkpointed(parsed_lines(lines))
        ops, manifests = operations_in(parsed, checkpointed(rejected_in(parsed))), manifests_of(told.select(F.from_json("value", MANIFEST).alias("m")).select("m.*"))
        turns = checkpointed(packaged.turn_metrics(ops, audio_chunks_in(parsed), manifests))
        whole = manifests.join(ops.select("session_id").distinct(), "session_id", "left_semi")  # a rejected package has none
        self.store.refresh(Facts.of(turns, packaged.call_metrics(turns, whole, ops), packaged.tool_metrics(ops), packaged.failure_metrics(ops, manifests), told.select(F.col("package").alias("session_id"))), number + 1)


def follow(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed a stream, as far as it has come, to what takes its micro-batches, then stop."""
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, id_col: str, time_col: str, by: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events of each tumbling window by ``by``; repeats of an id within the watermark count once."""
    unique = events.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])
    return unique.groupBy(F.window(time_col, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def collected(stream: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """The closed windows of a stream as a table: each is written once, when the watermark
    has passed its end, and forgotten by the stream. Windows still open come with later input."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
