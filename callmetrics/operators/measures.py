"""Distributions, sketches, rollups and the panels made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions.scalars import LAG_MS, bucket_floor
from callmetrics.sources.shared import checkpointed

# Sample counts below which a figure is no claim, and the sketch's base.
MIN_P50, MIN_P95, MIN_STABLE, MIN_DELTA, MIN_TOOL = 5, 20, 100, 30, 5
LN_GAMMA = 0.020000666706669543
HOUR_MS = 3_600_000
ALL_AGENTS = "__all__"
FAILED = "stt_failed + llm_failed + tts_failed + tool_failed"


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p * n)-th smallest value of a column, as an aggregate."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, weight): how often each value occurs under its key. Map-side sums shrink even
    a single key of all rows to its distinct values; negative ones count as NULL."""
    return df.withColumn("v", F.when(F.col(value) >= 0, F.col(value))).groupBy(*keys, "v").agg(F.count("*").alias("weight"))


def nearest_ranks(counts: DataFrame, keys: list[str], fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of value_counts() rows, and n, sum, least and greatest."""
    own = Window.partitionBy(*keys)
    known = F.when(F.col("v").isNotNull(), F.col("weight"))
    ranked = counts.withColumn("__upto", F.sum(known).over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum(known).over(own))
    reached = lambda p: F.min(F.when(F.col("v").isNotNull() & (F.col("__upto") >= F.ceil(F.col("__n") * F.lit(p))), F.col("v")))
    return ranked.groupBy(*keys).agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), *(reached(p).cast("double").alias(name) for name, p in fractions.items()), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum(F.col("v") * F.col("weight")).alias("total"))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, nearest-rank percentiles, extremes and mean of non-negative values, and
    whether there are enough of them to state p50 and p95."""
    found = nearest_ranks(value_counts(df, keys, value), keys, {f"p{p}": p / 100 for p in (50, 90, 95, 99)})
    n = F.col("n")
    return found.select(
        *keys, "n", "p50", "p90", "p95", "p99", "least", "greatest", F.round(F.col("total") / F.nullif(n, F.lit(0)), 6).alias("mean"),
        (n >= MIN_P50).alias("p50_confident"), (n >= MIN_P95).alias("p95_confident"), (n >= MIN_STABLE).alias("p95_stable"),
    )


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; every task passes on no more than that of a key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__nth") <= n).drop("__nth")


def linear_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentiles by linear interpolation, the rule of one call's own view."""
    p = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return df.groupBy(*keys).agg(p.alias("__p"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 6).alias("mean")).select(*keys, "n", *(F.round(F.get("__p", F.lit(i)), 6).alias(c) for i, c in enumerate(("p50", "p90", "p95"))), "least", "greatest", "mean")


def sketch_index(value: Column) -> Column:
    """Bucket of a value of at least 1; 0 below 1 stands for zeros; NULL for negatives."""
    return F.when(value < 0, F.lit(None)).when(value < 1, F.lit(-1)).otherwise(F.ceil(F.ln(value.cast("double")) / F.lit(LN_GAMMA))).cast("long")


def sketch_build(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A sketch as rows (keys, idx, weight, total, least, greatest); idx -1 holds the
    zeros. 1 % relative error; count, sum and extremes are exact, as each bucket keeps its own."""
    at = sketch_index(F.col(value))
    return df.withColumn("idx", at).filter("idx is not null").groupBy(*keys, "idx").agg(
        F.count("*").alias("weight"), F.sum(F.col(value).cast("double")).alias("total"), F.min(F.col(value).cast("double")).alias("least"), F.max(F.col(value).cast("double")).alias("greatest")
    )


def sketch_sums() -> list[Column]:
    """What merges buckets of one index."""
    return [F.sum("weight").alias("weight"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest")]


def sketch_merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merging in any order gives the same rows."""
    return sketches.groupBy(*keys, "idx").agg(*sketch_sums())


def sketch_value(idx: Column) -> Column:
    """The value that is as far, relatively, from both ends of a bucket; 0.0 for the zeros."""
    return F.when(idx == -1, 0.0).otherwise(2 * F.exp(idx * F.lit(LN_GAMMA)) / (F.exp(F.lit(LN_GAMMA)) + 1))


def sketch_ranks(sketches: DataFrame, keys: list[str], fractions: dict[str, float]) -> DataFrame:
    """(keys, the value at each nearest rank, n, total, least, greatest) of merged sketches; a
    value lies between the least and the greatest that the sketch has seen."""
    own = Window.partitionBy(*keys)
    ranked = sketch_merge(sketches, keys).withColumn("__upto", F.sum("weight").over(own.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("weight").over(own))
    reached = lambda p: F.min(F.when(F.col("__upto") >= F.ceil(F.round(F.col("__n") * F.lit(p), 9)), F.col("idx")))
    found = ranked.groupBy(*keys).agg(F.sum("weight").alias("n"), *(reached(p).alias(name) for name, p in fractions.items()), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"))
    inside = lambda name: F.greatest(F.col("least"), F.least(F.col("greatest"), sketch_value(F.col(name))))
    return found.select(*keys, "n", *(inside(name).alias(name) for name in fractions), "least", "greatest", "total")


def sketch_quantile(sketches: DataFrame, keys: list[str], p: float) -> DataFrame:
    """The value at the nearest rank, and how many there are."""
    return sketch_ranks(sketches, keys, {"quantile": p}).select(*keys, F.round("quantile", 6).alias("quantile"), "n")


def sketch_summary(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of distribution() from sketches, in whole milliseconds."""
    found = sketch_ranks(sketches, keys, {f"p{p}": p / 100 for p in (50, 90, 95, 99)})
    n, whole = F.col("n"), lambda c: F.bround(c).cast("double")
    return found.select(
        *keys, "n", *(whole(F.col(c)).alias(c) for c in ("p50", "p90", "p95", "p99", "least", "greatest")), whole(F.col("total") / n).alias("mean"),
        (n >= MIN_P50).alias("p50_confident"), (n >= MIN_P95).alias("p95_confident"), (n >= MIN_STABLE).alias("p95_stable"),
    )


def change(now: dict[str, Column], before: dict[str, Column]) -> Column:
    """{available, reason, previous, current, absolute, relative} between two periods'
    n and value (a percentile); claimed only where both have MIN_DELTA samples."""
    none = (F.coalesce(now["n"], F.lit(0)) == 0) | (F.coalesce(before["n"], F.lit(0)) == 0)
    few = (now["n"] < MIN_DELTA) | (before["n"] < MIN_DELTA)
    reason = F.when(none, "no_previous_period").when(few, "below_minimum_sample").when(F.coalesce(before["value"], F.lit(0)) == 0, "no_previous_period")
    ok = reason.isNull()
    return F.struct(
        ok.alias("available"), reason.alias("reason"), F.when(ok, before["value"]).alias("previous"), F.when(ok, now["value"]).alias("current"),
        F.when(ok, now["value"] - before["value"]).alias("absolute"), F.when(ok, F.round((now["value"] - before["value"]) / before["value"], 6)).alias("relative"),
    )


def period_delta(turns: DataFrame, start_ms: int, end_ms: int, metric: str = "response_ms") -> DataFrame:
    """p50 and p95 of a metric by agent, now and in the equal window before, and how they changed."""
    span = end_ms - start_ms
    period = F.when((F.col("started_ms") >= start_ms) & (F.col("started_ms") < end_ms), "now").when((F.col("started_ms") >= start_ms - span) & (F.col("started_ms") < start_ms), "before")
    tagged = turns.withColumn("period", period).filter("period is not null")
    stats = nearest_ranks(value_counts(tagged, ["agent_id", "period"], metric), ["agent_id", "period"], {"p50": 0.5, "p95": 0.95})
    of = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    both = stats.groupBy("agent_id").agg(*(of(p, c).alias(f"{c}_{p}") for p in ("now", "before") for c in ("n", "p50", "p95")))
    moved = {c: change({"n": F.col("n_now"), "value": F.col(f"{c}_now")}, {"n": F.col("n_before"), "value": F.col(f"{c}_before")}) for c in ("p50", "p95")}
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select("agent_id", count("n_now"), count("n_before"), moved["p50"].alias("change"), moved["p95"].alias("change_p95")).select("agent_id", "n_now", "n_before", "change.*", F.col("change_p95.absolute").alias("absolute_p95"), F.col("change_p95.relative").alias("relative_p95"))


def trend(turns: DataFrame, calls: DataFrame, start_ms: int, end_ms: int, width: int) -> DataFrame:
    """Every bucket of the range, empty ones too: calls that began in it, exchanges,
    failures, lag, and nearest-rank p50 and p95 of the reply latency of its turns."""
    spine = turns.sparkSession.range(start_ms // width * width, end_ms, width).select(F.col("id").alias("bucket_ms"))
    inside = lambda df: df.filter((F.col("started_ms") >= start_ms) & (F.col("started_ms") < end_ms)).withColumn("bucket_ms", bucket_floor(F.col("started_ms"), width))
    exchanges = F.count_if(~F.col("is_continuation")) if "is_continuation" in turns.columns else F.count("*")
    own = inside(turns)
    t = own.groupBy("bucket_ms").agg(exchanges.alias("turns"), F.sum(F.expr(FAILED)).alias("failed_ops"), F.count_if(F.col("response_ms") >= LAG_MS).alias("lag_turns"))
    p = nearest_ranks(value_counts(own, ["bucket_ms"], "response_ms"), ["bucket_ms"], {"p50": 0.5, "p95": 0.95}).select("bucket_ms", F.col("n").alias("measured"), "p50", "p95")
    c = inside(calls).groupBy("bucket_ms").agg(F.count("*").alias("calls"))
    found = spine.join(t, "bucket_ms", "left").join(p, "bucket_ms", "left").join(c, "bucket_ms", "left")
    return found.na.fill(0, ["turns", "failed_ops", "lag_turns", "measured", "calls"])


def tool_summary(tools: DataFrame) -> DataFrame:
    """By tool: invocations, calls, failures, timeouts, p50 and p95 of what was
    measured; ranked only from MIN_TOOL on. Counted by call first, so no call is distinct twice."""
    each = tools.groupBy("tool_name", "session_id").agg(F.count("*").alias("invocations"), F.count_if("failed").alias("failed"), F.count_if("timed_out").alias("timed_out"))
    counts = each.groupBy("tool_name").agg(*(F.sum(c).alias(c) for c in ("invocations", "failed", "timed_out")), F.count("*").alias("calls"), F.count_if(F.col("failed") > 0).alias("failed_calls"))
    stats = distribution(tools, ["tool_name"], "duration_ms").select("tool_name", F.col("n").alias("measured"), "p50", "p95", "p95_confident")
    return counts.join(stats, "tool_name").withColumn("rankable", F.col("invocations") >= MIN_TOOL)


def failure_summary(failures: DataFrame, limit: int | None = 12) -> DataFrame:
    """The most frequent failures by fingerprint and stage, or all of them."""
    found = failures.groupBy("fingerprint", "stage").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("calls"))
    return found if limit is None else found.orderBy(F.col("n").desc(), "fingerprint", "stage").limit(limit)


def placed(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Numbers the rows from 1 in ``order``, by ranges: each range is sorted in a task of its
    own and starts where those before it end."""
    ranked = checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__from"))  # one row per range
    own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(out, (F.col("__from") + own + 1).cast("int")).drop("__part", "__at", "__from")


def facets(turns: DataFrame, columns: list[str]) -> DataFrame:
    """Each value of each dimension, and when it was last seen."""
    return turns.select("started_ms", *columns).unpivot(["started_ms"], columns, "dimension", "value").filter("value is not null").groupBy("dimension", "value").agg(F.max("started_ms").alias("last_seen_ms"))


def cohort_rank(calls: DataFrame, value: str, newest: int = 25) -> DataFrame:
    """Among the newest calls of its agent, the share of values not above a call's own."""
    order = Window.partitionBy("agent_id").orderBy(F.col("started_ms").desc(), "session_id")
    sample = calls.withColumn("__rank", F.row_number().over(order)).filter((F.col("__rank") <= newest) & F.col(value).isNotNull())
    by_value = Window.partitionBy("agent_id").orderBy(value)
    return sample.withColumn("share_below", F.round(F.cume_dist().over(by_value), 6)).withColumn("typical", (F.col("share_below") >= 0.1) & (F.col("share_below") <= 0.9)).select("agent_id", "session_id", value, "share_below", "typical")
