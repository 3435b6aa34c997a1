"""Cases at the edge of the corpus operators: very long texts, very many repeats, clashing names, null ids, fits by hand."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callmetrics.llm import bpe, langid, sharding, simhash, topk, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_long_texts_are_scored_in_pieces(docs, monkeypatch):
    models = langid.fit(docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "a", "a b " * 60, "é" * 101]
    whole = models.score(texts)
    for piece in (1, 7, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        pieces = models.score(texts if piece > 1 else texts[-5:])
        n = len(pieces[0])
        assert (pieces[0] == whole[0][-n:]).all() and np.allclose(pieces[1], whole[1][-n:], atol=1e-5)


def test_every_document_of_a_language_is_cross_fitted(spark, docs, monkeypatch):
    seen = {}
    crossed = langid._cross_fitted

    def kept(sample, grams, order, letters):
        seen["rows"] = [tuple(r) for r in crossed(sample, grams, order, letters).collect()]
        seen["sample"] = [tuple(r) for r in sample.select("lang", "text", "fold").collect()]
        return crossed(sample, grams, order, letters)

    monkeypatch.setattr(langid, "_cross_fitted", kept)
    rare = [(900_000 + i, f"Tämä on lause numero {'aeiouy'[i]} jota muut eivät kirjoita", "fi") for i in range(3)]
    rows = docs.filter("lang in ('de', 'fr')").select("doc_id", "text", "lang").union(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    models = langid.fit(rows)
    letters = len({c for r in rows.collect() for c in langid.characters(r.text, langid.ORDER).tolist()})
    assert len(seen["rows"]) == rows.count() and np.isfinite(models.mean).all()
    for lang in ("fi", "fr"):
        want = []
        for fold in range(langid.FOLDS):
            others = langid._counted([t for x, t, f in seen["sample"] if x == lang and f != fold], langid.ORDER)
            levels, contexts, unknown = langid._kneser_ney(others.assign(lang=lang), [lang], langid.ORDER, letters)
            one = langid.Models([lang], langid.ORDER, levels, contexts, unknown, np.zeros(1), np.zeros(1))
            n, bits = one.score([t for x, t, f in seen["sample"] if x == lang and f == fold])
            want += zip(n.tolist(), bits[:, 0].tolist(), strict=True)
        got = sorted((n, b) for x, n, b in seen["rows"] if x == lang)
        assert [n for n, _ in got] == [n for n, _ in sorted(want)] and np.allclose([b for _, b in got], [b for _, b in sorted(want)], atol=1e-4)
        assert models.mean[models.languages.index(lang)] == pytest.approx(np.mean([b for _, b in want]) + langid.SLACK, abs=1e-4)


def test_rows_repeated_many_times_are_dealt_in_runs(spark, docs, monkeypatch):
    many = spark.range(300).select(F.lit(7).alias("doc_id"), F.lit("one row again and again").alias("text"))
    rows = docs.select("doc_id", "text").union(many)
    whole = sorted(map(tuple, sharding.balanced_shards(rows).collect()), key=repr)
    monkeypatch.setattr(sharding, "REPEATS", 7)
    assert sorted(map(tuple, sharding.balanced_shards(rows).collect()), key=repr) == whole
    assert len(whole) == rows.count() and len({(r[4], r[5]) for r in whole}) == len(whole)


def test_a_fit_is_the_least_of_its_loss():
    """Against Newton steps on the dense matrix of the same features."""
    rng = np.random.default_rng(5)
    n, words = 240, 12
    count = rng.integers(0, 3, (n, words)).astype(float)
    earlier = rng.normal(size=(n, 1))
    y = (rng.random(n) < 1 / (1 + np.exp(-(count[:, 0] - count[:, 1] + 0.5 * earlier[:, 0] - 0.3)))).astype(float)
    row, bucket = np.nonzero(count)
    w, e, b = toxicity._fit(row, bucket, count[row, bucket], earlier, y)
    share, texts = y.mean(), (count > 0).sum(0)
    pos = ((count > 0) * y[:, None]).sum(0)
    ratio = np.log((pos + toxicity.SMOOTHING * share) / (texts - pos + toxicity.SMOOTHING * (1 - share))) - np.log(share / (1 - share))
    x = np.column_stack([count * ratio, earlier, np.ones(n)])
    penalty = np.full(words + 2, toxicity.PENALTY)
    penalty[-1] = 0
    loss = lambda v: np.mean(np.logaddexp(0, x @ v) - y * (x @ v)) + 0.5 * (penalty * v * v).sum()
    v = np.zeros(words + 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ v)))
        v -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + np.diag(penalty), x.T @ (p - y) / n + penalty * v)
    own = np.concatenate([w[:words] / ratio, e, [b]])
    assert loss(v) <= loss(own) <= loss(v) + 1e-4
    assert np.abs(1 / (1 + np.exp(-(x @ own))) - 1 / (1 + np.exp(-(x @ v)))).max() < 0.02


def test_tied_scores_get_one_decision():
    z, y = np.array([2.0, 1.0, 1.0, 1.0, -1.0, -1.0]), np.array([1, 1, 0, 1, 0, 0])
    least = toxicity._threshold(z, y)
    assert [bool(1 / (1 + np.exp(-v)) >= least) for v in z] == [True] * 4 + [False] * 2
    assert toxicity._threshold(np.zeros(0), np.zeros(0)) == toxicity._threshold(z, np.ones(6)) == 0.5


def test_components_of_null_ids_have_no_name(spark):
    rows = [(None, "only rows without an id are here"), (None, "only rows without an id are here"), (4, "another text of quite different words indeed"), (None, None), (9, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got}) == 3
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (4, 4), (None, 9), (9, 9)}


def test_names_that_clash_and_empty_tables(spark, docs):
    rows = [(i, [float(i % 5), 1.0], "clash", "clash", "clash") for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank string, query_id string")
    plain = vectors.select("vec_id", "embedding")
    found = [sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 100 = 0")).collect())) for v in (topk.impacts(vectors), topk.impacts(plain))]
    assert found[0] == found[1] and len(found[0]) == 20
    path = public_tokenizers.path("word_bpe_49k.json")
    clash = docs.withColumn("n_tokens", F.lit("clash")).withColumn("ids_sha256", F.lit("clash"))
    assert bpe.encode_decode(clash, path, digests=True).schema["n_tokens"].dataType.simpleString() == "bigint"
    assert bpe.encode_decode(docs.limit(0), path, digests=True).count() == 0
