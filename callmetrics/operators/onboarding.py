"""How far calls have come from a key to captured spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_state(sessions: DataFrame, ops: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys``: calls begun, the first, the latest, the first with a span and the first
    whose manifest names an SDK version (by creation, then id), calls uploaded without any
    span, and calls still in flight; the last two only while nothing was captured at all.

    ``sessions`` holds session_id, created_ms, status and sdk_version; ``ops`` session_id.
    Spans are counted by call before they meet the calls.
    """
    counted = ops.groupBy("session_id").agg(F.count("*").alias("operations"))
    own = sessions.join(counted, "session_id", "left").withColumn("operations", F.coalesce("operations", F.lit(0).cast("long")))
    when = F.struct("created_ms", "session_id")
    first = lambda where=None: F.min(when if where is None else F.when(where, when))["session_id"]
    some = F.col("operations") > 0
    out = own.groupBy(*keys).agg(
        F.count("*").alias("sessions"), first().alias("first_session"), F.max(when)["session_id"].alias("latest_session"), first(some).alias("captured_session"), first(F.col("sdk_version").isNotNull()).alias("installed_session"),
        F.min_by("operations", F.when(some, when)).alias("captured_operations"), F.min_by("sdk_version", F.when(F.col("sdk_version").isNotNull(), when)).alias("sdk_version"),
        F.count_if(F.col("status") != "uploading").alias("__sent"), F.count_if(F.col("status") == "uploading").alias("__open"),
    )
    none = F.col("captured_session").isNull()
    empty = lambda c: F.when(none, F.col(c)).otherwise(F.lit(0).cast("long"))
    return out.withColumn("uploaded_without_operations", empty("__sent")).withColumn("in_flight", empty("__open")).drop("__sent", "__open")


def steps(state: DataFrame, keys: list[str], active_keys: int = 0) -> DataFrame:
    """By ``keys``, the four steps in order with their state and, where one waits, for what:
    a key, a manifest with a version, a call, or spans (none matched, an upload that never
    finished, or nothing uploaded). A step is verified only by what was seen."""
    waits = {
        "api-key": (F.lit(active_keys) > 0, F.lit("no_active_key")), "install": (F.col("installed_session").isNotNull(), F.when(F.col("sessions") > 0, "no_version_declared").otherwise("nothing_has_run")),
        "instrument": (F.col("sessions") > 0, F.lit("no_call")),
        "capture": (F.col("captured_session").isNotNull(), F.when(F.col("uploaded_without_operations") > 0, "no_operations_recorded").when(F.col("in_flight") > 0, "upload_never_finished").otherwise("nothing_uploaded")),
    }
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("step"), F.when(done, "verified").otherwise("waiting").alias("state"), F.when(~done, why).alias("waiting_for")) for i, (name, (done, why)) in enumerate(waits.items(), 1)))
    return state.select(*keys, F.inline(rows))
