"""Queries of transcripts that SQL cannot give, against plain Python over the same table."""

import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callmetrics.functions import scalars, text
from callmetrics.plans import measure_queries, registry  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def words(value):
    value = unicodedata.normalize("NFKC", value).lower()
    for sign, name in text.CURRENCY.items():
        value = value.replace(sign, name)
    kept = "".join(c if c in "'-" or c.isspace() or unicodedata.category(c)[0] in "LMN" else " " for c in value).split()
    return kept if re.search("[ऀ-ॿ]", value) else [text.NUMBER_WORDS.get(w, w) for w in kept]


@pytest.fixture(scope="module")
def alignments(spark):
    """By turn, the aligned words of production and challenger, by plain tables of costs."""
    from tests.test_text import plain_alignment

    out = {}
    for r in measure_queries._pairs(spark, SMALL).collect():
        out[r.conv_id, r.turn, r.role] = plain_alignment(words(r.production), words(r.challenger))
    return out


def test_alignment_counts(spark, alignments):
    kind = lambda a, b: "insertion" if b is None else "deletion" if a is None else "match" if a == b else "substitution"
    want = {k: Counter(kind(*x) for x in v) for k, v in alignments.items() if v}
    got = {(r.conv_id, r.turn, r.role): r for r in registry.QUERIES["X03_align"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert all(r[o] == want[k][o] for o in ("match", "substitution", "insertion", "deletion"))


def spoken(value):
    """Words as they were said, before numbers become digits."""
    value = unicodedata.normalize("NFKC", value).lower()
    for sign, name in text.CURRENCY.items():
        value = value.replace(sign, name)
    return "".join(c if c in "'-" or c.isspace() or unicodedata.category(c)[0] in "LMN" else " " for c in value).split()


def test_disagreed_words(spark, alignments):
    """By call, grouped by token, shown as first spoken, most frequent first, then by first turn."""
    said = {(r.conv_id, r.turn, r.role): (spoken(r.production), spoken(r.challenger)) for r in measure_queries._pairs(spark, SMALL).collect()}
    groups = {}
    for key in sorted(alignments, key=lambda k: (k[0], k[1], k[2])):
        ours, theirs = map(iter, said[key])
        turn_id = f"{key[1]:06d}/{key[2]}"
        for a, b in alignments[key]:
            p, c = (next(ours) if a is not None else None), (next(theirs) if b is not None else None)
            if a != b:
                own = groups.setdefault(key[0], {}).setdefault((a or "(missed)", b or "(extra)"), {"shown": (p or "(missed)", c or "(extra)"), "n": 0, "turns": []})
                own["n"] += 1
                own["turns"] += [] if turn_id in own["turns"] else [turn_id]
    want = {}
    for conv, own in groups.items():
        for place, (pair, g) in enumerate(sorted(own.items(), key=lambda x: (-x[1]["n"], x[1]["turns"][0])), 1):
            want[conv, *pair] = (*g["shown"], g["n"], len(g["turns"]), g["turns"][0], place)
    got = {(r.conv_id, r.production, r.challenger): (r.production_word, r.challenger_word, r["count"], r.turns, r.first_turn, r.place) for r in registry.QUERIES["A25_disagreed_words"](spark, SMALL).collect()}
    assert got == want


def test_surfaces_survive_alignment(spark):
    row = spark.createDataFrame([("It costs eight dollars, OK?", "it cost $8 ok now")], "p string, c string")
    diff = text.aligned_texts(row, "p", "c").first()["diff"]
    steps = [(x.operation, x.production, x.challenger, x.production_surface, x.challenger_surface) for x in diff]
    assert ("match", "8", "8", "eight", "8") in steps and ("match", "it", "it", "it", "it") in steps
    assert [x.production_surface for x in diff if x.production_index is not None] == ["it", "costs", "eight", "dollars", "ok"]
    assert [x.challenger_surface for x in diff if x.challenger_index is not None] == ["it", "cost", "dollars", "8", "ok", "now"]
    changed = text.aligned_texts(row, "p", "c").select(text.changed_words(F.col("diff")).alias("x")).first().x
    assert [(x["from"], x["to"], x["operation"]) for x in changed] == [s[1:3] + s[:1] for s in steps if s[0] != "match"]


def prose(value):
    bare = value.strip(" ")
    if not bare or bare.startswith(("data:", "{", "[")) or '{"' in bare:
        return False
    letters = sum(unicodedata.category(c)[0] == "L" for c in bare)
    if " " in bare and letters >= 3:
        return sum(c in '{}[]":,\\/' for c in bare) * 4 < letters
    digits = sum(unicodedata.category(c) == "Nd" for c in bare)
    return 9 <= digits <= 19 and digits >= len(bare) - 3


def test_personal_data_of_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    patterns = {"email": scalars.EMAIL, "phone": scalars.PHONE, "card": scalars.CARD, "id_number": scalars.ID_NUMBER}
    got = registry.QUERIES["P29_pii_scan"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        own = docs[r.doc_id]
        assert {k: r[k] for k in patterns} == {k: len(re.findall(p, own, re.ASCII)) if prose(own) else 0 for k, p in patterns.items()}
