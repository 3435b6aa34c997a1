"""Results of operators that SQL cannot give, against plain implementations and held-out rows."""

import itertools
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import psutil
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callmetrics.llm import bpe, digest, langid, licenses, queries, sharding, toxicity

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def brute_labels(text, k=licenses.GRAM, slack=licenses.SLACK):
    """(labels, score) by comparing words, template by template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    at = defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i : i + k])].append(i)
    for n, t in enumerate((*licenses.PHRASES, *licenses.NOTICES)):
        own = t.text.split()
        whole = len(own) - k + 1
        diagonals = defaultdict(set)
        for place in range(whole):
            for pos in at[tuple(own[place : place + k])]:
                diagonals[pos - place].add(place)
        reach, spans = max(slack, whole // 8), []
        for start in sorted(diagonals):
            if not spans or start - spans[-1][-1] > reach:
                spans.append([])
            spans[-1].append(start)
        for span in spans:
            middle = min(span, key=lambda s: (-len(diagonals[s]), s))
            found = len(set().union(*(diagonals[s] for s in span if abs(s - middle) <= max(reach, whole / 2)))) / whole
            exact = any(len(diagonals[s]) == whole for s in span)
            if exact if n < len(licenses.PHRASES) else found >= t.covered:
                labels.add(t.label)
                best = max(best, found)
    return ",".join(sorted(labels)), best


def test_license_labels_and_scores_against_words(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.integers(1, 4)):
            own = licenses.NOTICES[rng.integers(len(licenses.NOTICES))].text.split()
            own = [w for w in own if rng.random() > 0.04 * (i % 5)]
            for _ in range(rng.integers(0, 4)):
                own.insert(rng.integers(len(own) + 1), "inserted")
            words += ["filler"] * int(rng.integers(0, 30)) + own
        rows.append((i, " ".join(words)))
    rows += [(900, "free of charge " * 400 + licenses.NOTICES[1].text), (901, " ".join(licenses.NOTICES[1].text.split()[:40])), (902, None), (903, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("template", F.lit("clash"))
    found = licenses.scan(df).collect()
    assert len(found) == len(rows)
    for r in found:
        labels, score = brute_labels(dict(rows)[r.doc_id])
        assert (r.labels, r.score) == (labels, pytest.approx(score))
    by_id = {r.doc_id: r.labels for r in found}
    assert by_id[900] == "mit" and by_id[901] == ""


def test_toxicity_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")  # 3,980 labelled rows
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    chain = toxicity.fit_chain(docs, labels.filter(~held), queries.toxicity_categories())
    found = toxicity.classify(docs, chain).join(labels.filter(held).filter("toxic is not null").select("doc_id", F.col("toxic").alias("truth")), "doc_id").select("toxic", "truth").toPandas()
    hits = int((found["toxic"] & (found["truth"] == 1)).sum())
    assert (found["truth"] == 1).sum() >= 100
    assert hits / found["toxic"].sum() >= 0.95 and hits / (found["truth"] == 1).sum() >= 0.8


def test_conflicting_labels_and_repeats_do_not_change_the_chain(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    again = labels.filter("doc_id % 3 = 0").withColumn("toxic", 1 - F.col("toxic"))
    chains = [toxicity.fit_chain(docs.union(docs).repartition(n), labels.union(again).repartition(n), queries.toxicity_categories()) for n in (1, 3)]
    for a, b in zip(*(c.models for c in chains), strict=True):
        assert np.allclose(a.words, b.words) and a.bias == pytest.approx(b.bias)
    assert toxicity.classify(docs.limit(0), chains[0]).count() == 0


def brute_kneser_ney(texts, order, alphabet):
    """log2 P(last | rest) of an n-gram, by the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        for i in range(len(t) - order + 1):
            counts[order][t[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1

    def discount(k):
        ones, twos = (sum(1 for n in counts[k].values() if n == m) for m in (1, 2))
        return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5

    def probability(gram):
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        same = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return probability(gram[1:])
        total, d = sum(same.values()), discount(k)
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * probability(gram[1:])

    return lambda gram: np.log2(probability(gram))


def test_kneser_ney_by_its_definition():
    order = 3
    texts = {"a": ["the cat sat on the mat", "a cat that sat", "the dog"], "b": ["le chat dort", "un chien dort la", "la le"]}
    frames = [langid._counted(own, order).assign(lang=lang) for lang, own in texts.items()]
    counts = pd.concat(frames)
    levels, contexts, unknown = langid._kneser_ney(counts, ["a", "b"], order)
    models = langid.Models(["a", "b"], order, levels, contexts, unknown, np.zeros(2), np.zeros(2))
    letters = len(pd.unique(counts[["c0", "c1", "c2"]].to_numpy().ravel()))
    for j, lang in enumerate(texts):
        brute = brute_kneser_ney([tuple(langid.characters(t, order).tolist()) for t in texts[lang]], order, letters)
        for t in ["the chat", "un dog dort", "mat cat sat"]:
            chars = langid.characters(t, order)
            want = [brute(tuple(chars[i : i + order].tolist())) for i in range(len(chars) - order + 1)]
            assert np.allclose(models.log_probs(chars)[:, j], want, atol=1e-4)


def test_kept_encodings_stay_within_their_bytes():
    vocab = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    before = psutil.Process().memory_info().rss
    for i in range(20_000):
        vocab.encode(chr(0x4E00 + int(rng.integers(5000))) * 60 + f"{i}" * 40 + "".join(map(chr, rng.integers(0x4E00, 0x9000, 20))))
    assert psutil.Process().memory_info().rss - before < 120 << 20
    assert all(len(k) <= bpe.KEPT_CHARS for k in vocab.kept)


def canonical(text):
    folded = unicodedata.normalize("NFC", text or "").replace("ß", "ss").upper().lower().replace("ς", "σ")
    return re.sub(r"[\s\x85\xa0  -     　]+", " ", unicodedata.normalize("NFC", folded)).strip(" ")


def test_digests_and_neighbours_by_canonical_text(spark):
    texts = ["Straße  eins", "STRASSE EINS", "café", "café", "", None, "   ", "x" * 5000, "CafÉ ", "two", "two", "Two"]
    for ids in (range(len(texts)), [7] * len(texts), [10**15, *range(len(texts) - 1)], [None] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("canon", F.lit("clash")).withColumn("hash", F.lit("clash"))
        rows = sorted(zip(ids, [t or "" for t in texts], strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            want.append((i, len(t), canonical(t), canonical(t) == canonical(edited), canonical(t) == canonical(after)))
        got = digest.edited_digests(df).collect()
        assert sorted(Counter((r.doc_id, r.n_chars, r.near_edited == 1, r.near_next == 1) for r in got).items(), key=str) == sorted(Counter((w[0], w[1], w[3], w[4]) for w in want).items(), key=str)
        # equal canonical texts have equal fingerprints, others different ones
        assert Counter(Counter(r.fingerprint for r in got).values()) == Counter(Counter(w[2] for w in want).values())


def test_cuts_against_the_least_possible(spark):
    """Groups of equal texts on 3 shards of 4 rows: the cut is the least that balance allows, or at most one more for each shard."""
    for sizes in [(3, 3, 3), (4, 4, 4), (2, 2, 2, 2, 2, 2), (4, 3, 2), (5, 4, 3), (3, 3, 3, 3)]:
        rows = [g for g, n in enumerate(sizes) for _ in range(n)]
        rows += [-1 - i for i in range(12 - len(rows))]
        df = spark.createDataFrame([(i, f"text {g}") for i, g in enumerate(rows)], "doc_id long, text string")
        got = {r.doc_id: r.shard for r in sharding.balanced_shards(df, shards=3).collect()}
        assert sorted(Counter(got.values()).values()) == [4, 4, 4]

        def extra(placing):
            return sum(len({placing[i] for i, g in enumerate(rows) if g == own}) - 1 for own in range(len(sizes)))

        best = _least_cut(sizes, [4, 4, 4])
        assert best <= extra(got) <= best + 3


def _least_cut(sizes, rooms):
    """Fewest further shards that groups need to fit into ``rooms``."""
    if not sizes:
        return 0
    best = 99
    for part in itertools.product(*(range(min(sizes[0], r) + 1) for r in rooms)):
        if sum(part) == sizes[0]:
            best = min(best, sum(p > 0 for p in part) - 1 + _least_cut(sizes[1:], [r - p for r, p in zip(rooms, part, strict=True)]))
    return best
