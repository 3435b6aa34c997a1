"""Mixing, top-k, digests, sharding and licenses against brute force, and their edge cases."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callmetrics.llm import digest, licenses, mixing, queries, sharding, topk

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, ties, repeated rows.
ODD = [
    (1, "Alpha beta gamma delta epsilon", "en", "a", 5), (1, "Alpha beta gamma delta epsilon", "en", "a", 5), (2, "", "en", "a", 0), (3, None, None, None, None), (None, "only text", "fr", "b", 9),
    (4, "x " * 20_000, "en", "b", 40_000), (5, "ALPHA  beta\tgamma delta epsilon", None, "a", 5), (6, "!!! ... 123", "de", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("size", F.lit("clash")).withColumn("fingerprint", F.lit("clash")).withColumn("shard", F.lit("clash"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(queries.ORACLES[name])
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    tidy = lambda names, rows: sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in rows), key=repr)
    assert tidy(found.columns, found.collect()) == tidy(want.columns, want.fetchall())


def filled(sizes, cap=3, weights=(5, 2, 1)):
    """Targets by sharing the excess again and again."""
    total = sum(sizes)
    target, fixed = [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        share = sum(weights[i % 3] for i in free)
        for i in free:
            target[i] = left * weights[i % 3] / share
        over = [i for i in free if target[i] > cap * sizes[i] + 1e-9]
        if not over:
            return target
        for i in over:
            target[i] = cap * sizes[i]
            fixed.add(i)


@settings(max_examples=8, deadline=None)
@given(sizes=st.lists(st.integers(0, 1000), min_size=1, max_size=7).filter(lambda s: sum(s) > 0))
def test_targets_as_by_sharing_again(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    for i, want in enumerate(filled(sizes)):
        assert got[f"s{i}"] == pytest.approx(want, abs=1e-6)


def test_copies_follow_the_offset_and_the_cap(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), (F.col("id") % 50 + 1).alias("size"))
    mixed = mixing.systematic_copies(rows)
    sums = mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("x"), F.max("copies").alias("most")).collect()
    assert all(abs(r.x - r.t) <= 51 and r.most <= 3 for r in sums)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.systematic_copies(rows.repartition(7)).collect()))


def test_mixing_of_odd_rows(spark, odd):
    sized = odd.drop("size").withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.systematic_copies(sized)
    assert got.count() == len(ODD) and got.filter("source is null").first().target == 0
    assert mixing.systematic_copies(sized.limit(0)).count() == 0


def brute_top(rows, k=10):
    usable = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in usable.items():
        if q % 100 == 0:
            best = sorted(((-int(v @ w), i) for i, w in usable.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_with_ties_nulls_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(1200)]
    rows += [(5000, None), (5100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5200, [float("nan")] * 6), (5300, [float("inf")] * 6), (None, [0.5] * 6), (5400, rows[3][1]), (5401, rows[3][1])]
    vectors = topk.impacts(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    few = vectors.filter("vec_id < 3")
    assert sorted((r.query_id, r.vec_id) for r in topk.top_k(few, few.filter("vec_id = 0")).collect()) == [(0, 1), (0, 2)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_scores_beyond_floats_stay_whole(spark):
    big = 3_000_000.0
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0]), (3, [-big, 0.0])]
    vectors = topk.impacts(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(vectors, vectors.filter("vec_id = 0"))
    assert [(r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(n, i, s) for _, n, i, s in brute_top(rows)]


UNICODE = st.text(st.sampled_from("aeEiß ςΣſ̧̣́̇ͅéạÅÅ각각क़োﬁ  \n"), max_size=8)


@settings(max_examples=1, deadline=None)
@given(st.lists(UNICODE, min_size=150, max_size=200))
def test_composed_form(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.c for r in df.select(digest.composed(F.col("text")).alias("c")).collect()] == [unicodedata.normalize("NFC", t) for t in texts]


def test_equal_texts_share_a_digest_and_others_do_not(spark):
    rows = [(1, "Café  au\nlait"), (2, "café AU lait "), (3, "cafe au lait"), (4, None), (5, "  "), (6, "STRASSE"), (7, "straße")]
    got = {r.doc_id: r.fingerprint for r in digest.exact_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] and got[6] == got[7]


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digest, "wide_hash", lambda text: F.when(text == "", "b").otherwise("a"))
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, "")]
    got = {r.doc_id: r.fingerprint for r in digest.exact_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 4


def test_edited_digests(spark, docs, odd):
    for df in (docs, spark.createDataFrame([(9, "sole")], "doc_id long, text string"), odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
        got = {r.doc_id: r for r in digest.edited_digests(df).collect()}
        assert len(got) == len(rows)
        for n, (i, t) in enumerate(rows):
            half, after = len(t) // 2, rows[(n + 1) % len(rows)][1]
            want = t[: len(t) - half] + after[:half]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
            assert (got[i].near_edited == 1) == (got[i].fingerprint == got[i].edited_fingerprint)
    assert digest.edited_digests(docs.limit(0)).count() == 0 and digest.edited_digests(odd).count() == len(ODD)


def test_next_document_for_ids_of_any_kind(spark):
    far = [(i, f"text {i % 7}") for i in range(300)] + [(10**15, "far"), (-(10**15), "low")] + [(None, f"none {i}") for i in range(200)]
    shared = [(5, f"same id {i}") for i in range(300)] + [(5, "repeat")] * 300 + [(4, "after")]
    named = [(f"id {i}", f"Text {i % 3}") for i in range(50)] + [(None, "none")]
    for rows, kind in ((far, "long"), (shared, "long"), (named, "string")):
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        numbered = digest.numbered_by_id(df)
        assert numbered.count() == len(rows) and numbered.groupBy("part").count().agg(F.max("count")).first()[0] < len(rows) / 4
        got = digest.followed(numbered).collect()
        # next texts are the texts once each, and the ids descend around the circle
        assert Counter(r.next_text for r in got) == Counter(t for _, t in rows)
        sole = {t: i for i, t in rows} if len({t for _, t in rows}) == len(rows) else {}
        ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None] * any(i is None for i, _ in rows)
        text_of = {}
        for i, t in rows:
            text_of.setdefault(i, set()).add(t)
        for r in got:
            after = ids[(ids.index(r.doc_id) + 1) % len(ids)]
            assert r.next_text in text_of[after] or r.next_text in text_of[r.doc_id]
            assert not sole or sole[r.next_text] in (after, r.doc_id)
        want = digest.exact_digests(df.select(F.col("text").alias("doc_id"), "text")).dropDuplicates(["doc_id"]).collect()
        print_of = {r.doc_id: r.fingerprint for r in want}
        for r in got:
            assert (r.hash, r.next_hash) == (print_of[r.text], print_of[r.next_text])


def test_shards_are_even_and_groups_stay_together(spark, docs, odd):
    hot = docs.select("doc_id", "text").union(spark.range(150).selectExpr("id + 90000", "'the same text'"))
    for df in (docs, odd, hot):
        rows = sharding.balanced_shards(df).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == df.count() and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    text = {r.doc_id: r.text for r in hot.collect()}
    spans = {}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
        spans.setdefault(text[r.doc_id], []).append(r.shard)
    split = [t for t, s in spans.items() if 1 < len(s) <= 3 and len(set(s)) > 1]
    assert len(split) <= 2 and len(set(spans["the same text"])) <= 14
    assert sharding.balanced_shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("paired", [1.0, 0.6])
def test_copies_meet_where_shards_are_full_of_them(spark, paired):
    n = 1600
    text = F.when(F.col("id") % 800 < 800 * paired, F.concat(F.lit("copy "), F.xxhash64(F.col("id") % 800))).otherwise(F.concat(F.lit("sole "), "id"))
    df = spark.range(n).select(F.xxhash64("id").alias("doc_id"), text.alias("text"))
    for rounds in (sharding.ROUNDS, 0):  # without rounds, all groups are put in a row
        rows = sharding.balanced_shards(df, rounds=rounds).join(df, "doc_id").collect()
        counts = Counter(r.shard for r in rows)
        spans = {}
        for r in rows:
            spans.setdefault(r.text, set()).add(r.shard)
        assert len(rows) == n and set(counts.values()) == {n // 16}
        assert sum(len(s) > 1 for s in spans.values()) <= 15


def test_moves_that_quotas_admit():
    assert sharding._admitted({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding._admitted({(0, 1): 5, (1, 0): 3}, [0, 1]) == {(0, 1): 4, (1, 0): 3}
    assert sharding._admitted({(0, 1): 2, (1, 2): 2, (2, 0): 1}, [0, 0, 0]) == {(0, 1): 1, (1, 2): 1, (2, 0): 1}


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_places(spark, docs, odd):
    extra = [(70_001, "Under the MIT License. " * 300), (70_002, "cc-by-nc cc by cc by nc Apache License, Version 2.0"), (70_003, "under theé mit license"), (70_004, "permission is hereby granted free of all charge to any person obtaining a copy of this software")]
    for df in (docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")), odd.select("doc_id", "text")):
        got = licenses.scan(df).collect()
        text = {r.doc_id: r.text for r in df.collect()}
        assert len(got) == df.count()
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(text[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            if r.doc_id == 70_004:
                assert r.labels == "mit"
    assert licenses.scan(docs.limit(0)).count() == 0
