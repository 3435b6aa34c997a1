"""Transcript scores against a plain implementation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callmetrics.functions import text
from callmetrics.functions.scalars import pii_scan, redact_secrets
from callmetrics.operators import evaluation


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


WORDS = st.lists(st.sampled_from(["one", "two", "we", "go", "नौ", "x"]), min_size=1, max_size=8).map(" ".join)


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=30, max_size=40))
def test_built_in_errors_equal_the_alignment(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, c string")
    left, right = text.tokens(text.normalized(F.col("p"))), text.tokens(text.normalized(F.col("c")))
    for r in df.select(left.alias("l"), right.alias("r"), text.align(left, right).alias("diff"), text.scored_pair(F.col("p"), F.col("c")).alias("s")).collect():
        assert r.s.errors == distance(r.l, r.r) == sum(x.operation != "match" for x in r["diff"])
        assert r.s.wer == pytest.approx(r.s.errors / len(r.r))


def test_sides_that_are_missing(spark):
    rows = [(None, None), ("a b", None), (None, "a b"), ("eight rooms", "8 rooms"), ("a b c d", "a")]
    got = [(r.s.status, r.s.errors, r.s.wer, r.s.band) for r in spark.createDataFrame(rows, "p string, c string").select(text.scored_pair(F.col("p"), F.col("c")).alias("s")).collect()]
    assert got == [("no_speech", 0, None, "unavailable"), ("challenger_empty", 0, None, "unavailable"), ("possible_missed_speech", 2, 1.0, "high"), ("evaluated", 0, 0.0, "low"), ("evaluated", 3, 3.0, "high")]


def test_a_missed_word_is_a_deletion(spark):
    df = spark.sql("select array('a', 'c') as p, array('a', 'b', 'c') as c")
    assert [x.operation for x in df.select(text.align(F.col("p"), F.col("c")).alias("d")).first().d] == ["match", "deletion", "match"]


def test_marks_and_compatibility_forms_stay(spark):
    df = spark.createDataFrame([("नौ, ₹5!",), ("ﬁve Ⅷ",)], "t string")
    assert [r.n for r in df.select(text.normalized(F.col("t")).alias("n")).collect()] == ["नौ rupees 5", "five viii"]


def test_secrets_and_personal_data(spark):
    df = spark.createDataFrame([("key AKIAABCDEFGHIJKL12 and bearer abcdefghijklmnop",), ("call me at a.b@example.com or +91 98765 43210 please",), ('{"a": "a@b.com"}',)], "t string")
    rows = df.select(redact_secrets(F.col("t")).alias("r"), pii_scan(F.col("t")).alias("p")).collect()
    assert rows[0].r.found == 2 and "AKIA" not in rows[0].r.text
    assert (rows[1].p.email, rows[1].p.phone) == (1, 1) and rows[2].p.email == 0


def test_partial_revisions(spark):
    rows = [("c", 1, "i want", False), ("c", 2, "i want a", False), ("c", 3, "i need a", False), ("d", 1, "x", True)]
    got = {r.k: (r.hypotheses, r.revisions) for r in evaluation.partial_revisions(spark.createDataFrame(rows, "k string, seq int, text string, truncated boolean"), ["k"]).collect()}
    assert got == {"c": (3, 2), "d": (1, None)}


def test_a_cut_reply_gives_way_to_the_whole(spark):
    long = "this reply goes on for quite a while and then some"
    rows = [("s", "user", "hi", 1, 0), ("s", "user", "hi", 2, 0), ("s", "assistant", long[:30], 1, 1), ("s", "assistant", long, 2, 1), ("s", "user", "hi", 2, 2)]
    got = evaluation.transcript(spark.createDataFrame(rows, "session_id string, role string, text string, op_id int, position int"))
    assert sorted((r.role, r.text, r.op_id, r.position) for r in got.collect()) == [("assistant", long, 2, 1), ("user", "hi", 1, 0), ("user", "hi", 2, 2)]


def test_compatibility_forms_are_no_errors(spark):
    df = spark.createDataFrame([("ﬁve rooms ５", "five rooms 5")], "p string, c string")
    assert df.select(text.scored_pair(F.col("p"), F.col("c")).alias("s")).first().s.errors == 0


def test_many_distinct_tokens(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(36_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("p"))
    df = df.withColumn("c", F.slice("p", 35_900, 101)).withColumn("p", F.slice("p", 1, 36_000))
    assert df.select(text.token_edit_distance(F.slice("p", 35_950, 51), F.col("c")).alias("n")).first().n == 50
    spread = df.select(text.token_edit_distance(F.concat("p", F.array(F.lit("new"))), F.slice("p", 1, 2)).alias("n")).first()
    assert spread.n == 35_999


def plain_alignment(left, right):
    """Every path by the definition: the same costs and the same order among equals."""
    cost = {(0, j): j for j in range(len(right) + 1)} | {(i, 0): i for i in range(len(left) + 1)}
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (left[i - 1] != right[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    i, j, out = len(left), len(right), []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (left[i - 1] != right[j - 1]):
            i, j = i - 1, j - 1
            out.append((left[i], right[j]))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((left[i], None))
        else:
            j -= 1
            out.append((None, right[j]))
    return out[::-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_alignments_by_their_definition(left, right):
    got = [(x["production"], x["challenger"]) for x in text._aligned(left, right)]
    assert got == plain_alignment(left, right)
