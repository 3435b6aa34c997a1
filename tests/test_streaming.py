"""Stores of arrivals and packages end in the state that a batch gives."""

import json

import pytest
from pyspark.sql import functions as F

from callmetrics.operators import facts, measures, rollups
from callmetrics.plans.dashboard_queries import _flat, _package
from callmetrics.sources import nested
from callmetrics.sources.binding import operations
from callmetrics.streaming.rollups import Facts, FactStore, Inbox

SMALL = "/root/testdata/sf0.001"


def plain(df):
    names = sorted(c for c in df.columns if not c.endswith("_hll"))
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def estimates(tier, sketch):
    return plain(tier.groupBy("bucket_ms", "agent_id").agg(rollups.estimate(sketch).alias("calls")))


def same(store, want):
    for name in rollups.Tiers.NAMES:
        assert plain(store.tier(name)) == plain(getattr(want, name)), name
    assert estimates(store.tier("intervals"), "llm_failed_calls_hll") == estimates(want.intervals, "llm_failed_calls_hll")


def test_reupload_with_fewer_turns_leaves_nothing_behind(spark, tmp_path):
    turns, calls, tools, failures = _flat(spark, SMALL)
    store = FactStore(spark, f"file://{tmp_path}")
    store.refresh(Facts.of(turns, calls, tools, failures), 1)
    session = turns.groupBy("session_id").count().orderBy("count", ascending=False).first().session_id
    other = lambda df: df.filter(F.col("session_id") != session)
    fewer = turns.filter(F.col("session_id") == session).orderBy("started_ms").limit(1)
    again = Facts.of(fewer, facts.call_facts(fewer), tools.limit(0), failures.limit(0))
    store.refresh(again, 2)
    want = rollups.build(other(turns).unionByName(fewer), other(calls).unionByName(facts.call_facts(fewer)), other(tools), other(failures))
    same(store, want)
    store.refresh(again, 2)  # the same version once more
    same(store, want)
    assert store.pending().count() == 0
    compacted = store.compact()
    same(compacted, want)
    compacted.refresh(Facts.of(turns, calls, tools, failures), 3)  # and everything as it was at first
    same(compacted, rollups.build(turns, calls, tools, failures))


def test_bounded_passes_take_the_oldest_keys_first(spark, tmp_path):
    turns, calls, tools, failures = _flat(spark, SMALL)
    store = FactStore(spark, f"file://{tmp_path}")
    store.add(Facts.of(turns, calls, tools, failures))
    dirty = sorted((r.bucket_ms, r.agent_id) for r in store.pending().collect())
    store.rebuild(limit=40)
    assert sorted((r.bucket_ms, r.agent_id) for r in store.pending().collect()) == dirty[40:]
    built = {(r.bucket_ms, r.agent_id) for r in store.tier("intervals").collect()}
    assert built and built <= set(dirty[:40])  # hours of tools or failures alone have no row here
    compacted = store.compact()
    assert compacted.pending().count() == len(dirty) - 40
    compacted.rebuild()
    same(compacted, rollups.build(turns, calls, tools, failures))


def test_packages_wait_for_their_manifest_and_are_rejected_as_a_whole(spark, tmp_path):
    lines, told = nested.lines(spark, SMALL), nested.manifest_lines(spark, SMALL)
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), "package", "value")
    bad = told.orderBy("package").first().package
    third = lambda df, k: df.filter(F.pmod(F.hash("value"), F.lit(3)) == k)
    store = FactStore(spark, f"file://{tmp_path}/store")
    inbox = Inbox(spark, f"file://{tmp_path}/inbox", store)
    inbox.take(tagged(third(lines, 0), "line"), 0)
    assert not (tmp_path / "store").exists() or not (tmp_path / "store/g0/facts").exists()
    inbox.take(tagged(third(lines, 1), "line").union(tagged(told, "manifest")), 1)
    inbox.take(tagged(third(lines, 2), "line"), 2)
    turns, calls, tools, failures = _package(spark, SMALL)
    same(store, rollups.build(turns, calls, tools, failures))
    inbox.take(spark.createDataFrame([("line", bad, "{not json")], "kind string, package string, value string"), 3)
    good = lambda df: df.filter(F.col("session_id") != bad)
    same(store, rollups.build(good(turns), good(calls), good(tools), good(failures)))


def test_sketches_keep_moments_and_quantiles_within_one_percent(spark):
    turns = facts.turn_facts(operations(spark, SMALL)).filter("response_ms is not null").withColumn("all", F.lit(0))
    exact = measures.distribution(turns, ["all"], "response_ms").first()
    parts = measures.sketch_build(turns, ["all", "agent_id"], "response_ms")
    merged = measures.sketch_summary(parts, ["all"]).first()
    assert (merged.n, merged.least, merged.greatest) == (exact.n, exact.least, exact.greatest)
    assert merged["mean"] == round(exact["mean"])
    for p in ("p50", "p90", "p95", "p99"):
        assert abs(merged[p] - exact[p]) <= 0.011 * exact[p]


@pytest.mark.parametrize("values", [[7.0], [0.0, 0.0, 0.4], [0.2, 5.0, 5.0, 900.0]])
def test_sketch_answers_lie_between_what_was_seen(spark, values):
    rows = spark.createDataFrame([(1, v) for v in [*values, -3.0, None]], "k int, v double")
    got = measures.sketch_summary(measures.sketch_build(rows, ["k"], "v"), ["k"]).first()
    assert got.n == len(values) and got.least == round(min(values)) and got.greatest == round(max(values))
    assert all(got.least <= got[p] <= got.greatest for p in ("p50", "p90", "p95", "p99"))
    assert json.loads(json.dumps(got.asDict()))["p95_confident"] is False


def test_a_pass_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40_000).select("id", F.lit(3).alias("pass")).repartition(4)
    for _ in range(2):  # once more, as after a failure
        FactStore._write(rows, str(tmp_path / "t"), ["pass"], dealt=False)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40_000
    assert len(list((tmp_path / "t/pass=3").glob("*.parquet"))) == 4
