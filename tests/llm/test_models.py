"""Language, toxicity, language-model scores, BPE and SimHash against brute force and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from callmetrics.llm import bpe, langid, maxent, queries, simhash, toxicity
from callmetrics.llm.words import NOT_SPACE, chunks
from tests.llm.test_native import DOCS, ODD

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("fp", F.lit("clash"))


def test_bpe_is_the_librarys(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, "it's <|endoftext|> don't <|start"), (2, "ΑΣ Σσς İı   x\x1cy 한글 1½"), (3, "supercalifragilistic" * 40), (4, ""), (5, None), (6, "é" * 5)]
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string")):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        got = bpe.encode_decode(df, path, digests=True).collect()
        assert len(got) == df.count()
        for r in got:
            ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
            want = b"".join(i.to_bytes(4, "little") for i in ids)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(want).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    plain = bpe.encode_decode(docs.limit(3), path).first()
    assert len(plain.ids) == plain.n_tokens and bpe.vocabulary(path).decode(plain.ids) == plain.decoded


def brute_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=4):
    names = list(range(len(values)))
    near = np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None, :]) <= radius
    while True:
        new = [min(names[j] for j in np.flatnonzero(near[i])) for i in range(len(values))]
        if new == names:
            return names
        names = new


def test_simhash_of_documents(spark, docs, odd):
    for df in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        values = [brute_fingerprint(t) for _, t in rows]
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
        assert got == {rows[i][0]: (f"{values[i]:016x}", rows[c][0]) for i, c in enumerate(brute_components(values))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(odd).filter("doc_id is null").count() == 1


def test_every_close_pair_is_linked_even_in_large_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = list(base) + [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base for _ in range(6)]
    values = sorted({int(v) for v in values})
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    monkeypatch.setattr(simhash, "SHARD_ROWS", 3)  # nearly every shard is cut into parts
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    root = dict(map(tuple, found.collect()))
    groups = {}
    for i, name in enumerate(brute_components(values)):
        groups.setdefault(name, set()).add(root.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_one_of_each_group_stays(spark, docs):
    kept = simhash.keep_one(docs)
    parts = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in parts.select("component_id").distinct().collect()}
    twice = docs.limit(20).union(docs.limit(20))
    assert simhash.keep_one(twice).count() == simhash.keep_one(docs.limit(20)).count()


def test_languages_of_held_out_documents(spark):
    found = queries.op4_language(spark, MORE)
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.accepted for r in rows) >= 0.995 * len(rows)


def test_languages_of_odd_rows(spark, docs, odd):
    models = langid.fit(spark.read.parquet(f"{MORE}/documents.parquet"))
    assert langid.identify(odd, models).count() == len(ODD)
    pred, score, accepted = langid.predict(models, [None, "", "123 !?", "这是一个中文句子没有字母" * 3])
    assert pred[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and not accepted.any()
    assert langid.identify(docs.limit(0), models).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_rare_languages_are_learnt_and_have_limits(spark, docs):
    one = spark.createDataFrame([(900_001, "Tämä on suomenkielinen lause, jota kukaan muu ei kirjoita tässä taulukossa.", "fi")], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(one)
    models = langid.fit(rows)
    assert set(models.languages) == {r.lang for r in rows.select("lang").distinct().collect()} - {None, "und"}
    assert np.isfinite(models.mean).all() and np.isfinite(models.width).all()
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 400)) for _ in range(20)]
    foreign = ["这是一个中文句子没有字母" * 9, "съешь же ещё этих мягких французских булок " * 9, "ένα δύο τρία τέσσερα πέντε " * 9]
    assert not langid.predict(models, noise + foreign)[2].any()
    assert langid.identify(rows, models).filter("accepted").count() >= 0.99 * rows.count()


def test_probabilities_sum_to_one(spark, docs):
    models = langid.fit(docs)
    letters = sorted({c for t in docs.select("text").limit(100).collect() for c in langid.characters(t.text, 4).tolist()})
    for context in ("   ", " th", "ent"):
        total = sum(2.0 ** models.log_probs(np.array([*map(ord, context), c], np.int32))[-1] for c in letters)
        assert (total <= 1.001).all() and (total > 0.9).all()


def test_toxic_documents_are_caught(spark, odd):
    found = queries.op3_toxicity(spark, MORE).join(spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    toxic, clean = [r for r in found if r.label == 1], [r for r in found if r.label == 0]
    assert sum(r.toxic for r in toxic) >= 0.95 * len(toxic) and sum(r.toxic for r in clean) <= 0.01 * len(clean)
    chain = queries.toxicity_chain(spark, SMALL)
    assert toxicity.classify(odd, chain).count() == len(ODD)
    assert toxicity.without(odd, chain, "toxic").columns == odd.columns


def test_a_chain_without_labels_is_constant(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, none, queries.toxicity_categories())
    assert toxicity.classify(docs, chain).filter("toxic").count() == 0


def test_scores_against_brute_force(spark, docs, odd):
    trains = queries.crc32_of_id() % 7 != 2
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), ""] for _, t in rows]
        held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
        count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
        n, v = sum(count.values()), len(count)
        want = sorted(((i is None, i or 0), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4)) for (i, _), t in zip(rows, tokens, strict=True))
        got = maxent.train_and_score(df, trains, block_docs=50).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert maxent.train_and_score(docs.limit(0), trains).count() == 0


def test_blocks_are_bounded_by_bytes_and_change_nothing(spark, docs):
    long = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.repeat("text", F.lit(40))).otherwise(F.col("text")).alias("text"))
    blocks = long.select(maxent.block_of("text", 16).alias("block"), F.octet_length("text").alias("n")).groupBy("block").agg(F.sum("n").alias("bytes"), F.count("*").alias("rows")).collect()
    assert all(r.rows == 1 or (r.rows <= 16 and r.bytes <= 16 * maxent.TEXT_BYTES) for r in blocks) and max(r.rows for r in blocks) > 8
    trains = F.col("doc_id") % 3 != 0
    scored = [sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in maxent.train_and_score(long, trains, block_docs=n).collect()) for n in (16, 5000)]
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3]) for a, b in zip(*scored, strict=True))


def test_the_model_beats_unigrams_on_held_out_documents(spark):
    held = queries.op5_maxent(spark, MORE).filter("held_out").agg(F.sum("score").alias("own"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert (held.own - held.base) / held.n > 0.15


def random_model(rng, tokens=100, distinct=30):
    mass = rng.integers(1, 50, maxent.CLASSES * maxent.WIDTH).astype(float)
    return maxent.Model([rng.normal(size=(r, maxent.WIDTH)).astype(np.float32) for r in maxent.ROWS], maxent.priors(mass), np.log10(mass), tokens, distinct)


def test_class_and_bin_probabilities_sum_to_one():
    model = random_model(np.random.default_rng(0))
    total = 0.0
    for k in range(maxent.CLASSES):
        for b in range(maxent.WIDTH if k else 1):
            seq = maxent.Sequence(np.array([7, 9, 11]), np.array([3, 200, k], np.int32), np.array([1, 2, b], np.int32), np.array([0, 3]))
            total += 10 ** model.history_scores(seq)[2]
    assert total == pytest.approx(1, abs=1e-4)


def test_scores_by_their_definition():
    """Softmax by softmax with Python numbers, for two short texts."""
    rng = np.random.default_rng(1)
    model = random_model(rng)
    texts = pa.array(["The cat the cat sat", "a"])
    (low, high, words), *_ = chunks(texts, NOT_SPACE)
    seq = maxent.sequence(words)
    count = rng.integers(0, 9, len(seq.token))
    known, base, own = model.score(seq, count)
    rows = maxent.features(seq)
    want = []
    for t in range(len(seq.token)):
        klass, bin_ = int(seq.klass[t]), int(seq.bin[t])
        group, member = divmod(klass, 16)
        logs = 0.0
        for level, (shift, before, target) in enumerate(((0, 0, group), (group, group, member), (0, klass, bin_))):
            z = [float(model.prior[level][before][j]) + sum(float(model.weights[level][int(f[t]) + shift][j]) for f in rows[level]) for j in range(16)]
            if level < 2 or klass:
                logs += (z[target] - math.log(sum(map(math.exp, z)))) / math.log(10)
        want.append(logs + math.log10(count[t] + 1) - model.share[klass * 16 + bin_])
    assert seq.cut.tolist() == [0, 6, 8] and known.tolist() == [int((count[:6] > 0).sum()), int((count[6:] > 0).sum())]
    assert own.tolist() == pytest.approx([sum(want[:6]), sum(want[6:])], abs=1e-3)
    assert base.tolist() == pytest.approx([sum(math.log10((c + 1) / 131) for c in part) for part in (count[:6], count[6:])])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in out.collect())
        assert set(after) <= set(before)
        assert name == "mixing" or max(after.values()) == 1
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name_and_empty_tables(spark, stage):
    names = ("size", "copies", "target", "taken", "source_size", "lang_pred", "score", "fingerprint", "component_id", "toxic", "hash", "words", "__doc")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in names))
    out = stage(spark, docs, SMALL)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text", "size", "target", "__doc").collect()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert rows and all((r.text, r["size"], r.target, r["__doc"]) == (text[r.doc_id], f"size {r.doc_id}", f"target {r.doc_id}", f"__doc {r.doc_id}") for r in rows)
    assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_stages_take_nulls_in_every_column(spark, odd):
    docs = spark.createDataFrame(ODD, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in ODD}
