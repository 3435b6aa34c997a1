"""Language-model scores from a hashed maximum-entropy model.

A word's probability is factored by class: P(class | history) P(word | class, history).
The class is told by the spelling (a hash of the last three bytes), so that words never
seen have one too. It is predicted in two softmax steps, 16 groups of 16 classes, from
hashed features: the classes of the words before it (one back, the pair, and a skip of
one) and the last word itself. Within its class a word is in one of 16 bins by its hash; a
third softmax step predicts the bin from the class, the last word and the one before it,
and in its bin a word has its add-one share of the training tokens, which come from all
training documents. Each task makes gradient updates over the documents it reads; the
tasks' weights are averaged by the tokens they saw. The weights tell what history adds to
the shares of classes and bins, so a model that has learnt nothing scores as unigrams do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.storage import written
from callmetrics.llm.words import NOT_SPACE, Words, chunks, mix64

#: 16 groups of 16 classes; class 0 is the end of a text.
WIDTH = 16
CLASSES = WIDTH * WIDTH
#: The class before a text begins.
START = CLASSES
#: Rows of weights of the three steps; row numbers fit 16 bits, which sort fast.
ROWS = (1 << 14, 1 << 16, 1 << 15)
#: Documents whose distinct words are looked up together, and bytes of one of them at most;
#: blocks of longer texts hold fewer.
BLOCK_DOCS = 8192
TEXT_BYTES = 32768
BATCH = 4096
RATE = 0.3
END = np.int64(-6148914691236517206)


class Sequence(NamedTuple):
    """Tokens of some whole texts, each closed by an end; text i has tokens ``cut[i]`` to ``cut[i + 1]``."""

    token: np.ndarray
    klass: np.ndarray
    bin: np.ndarray
    cut: np.ndarray


def sequence(words: Words) -> Sequence:
    rows = words.rows
    n = len(rows) - 1
    cut = rows + np.arange(n + 1)
    token = np.full(int(cut[-1]), END, np.int64)
    klass = np.zeros(int(cut[-1]), np.int32)
    at = np.arange(len(words.start)) + words.row_of()
    token[at] = words.hashes().view(np.int64)
    klass[at] = 1 + (words.suffix_hashes(3) % np.uint64(CLASSES - 1)).astype(np.int32)
    return Sequence(token, klass, bin_of(token), cut)


def bin_of(token: np.ndarray) -> np.ndarray:
    """The bin of each token within its class."""
    return (mix64(token.view(np.uint64)) >> np.uint64(60)).astype(np.int32)


def features(seq: Sequence) -> list[list[np.ndarray]]:
    """Weight rows of each token's features for the three softmax steps; for the second
    before the group is added."""
    n = len(seq.token)
    place = np.arange(n) - np.repeat(seq.cut[:-1], np.diff(seq.cut))

    def back(values: np.ndarray, k: int, start: int) -> np.ndarray:
        out = np.full(n, start, values.dtype)
        out[k:] = values[: n - k] if k < n else []
        out[place < k] = start
        return out

    klass = seq.klass.astype(np.int64)
    one, two = back(klass, 1, START), back(klass, 2, START)
    hashed = mix64(seq.token.view(np.uint64)) >> np.uint64(20)
    word, skipped = back(hashed, 1, 0), back(hashed, 2, 0)
    pair = (mix64((one * 1009 + two).astype(np.uint64)) % np.uint64(7168)).astype(np.int64) + 1024
    first = [one, 300 + two, pair, 8192 + (word % np.uint64(8192)).astype(np.int64)]
    second = [WIDTH * one, WIDTH * (520 + (word % np.uint64(ROWS[1] // WIDTH - 520)).astype(np.int64))]
    own = klass.astype(np.uint64) << np.uint64(44)
    with_class = lambda x, salt: (mix64(x ^ own ^ np.uint64(salt)) % np.uint64(ROWS[2])).astype(np.int64)
    third = [with_class(word, 0), with_class(skipped, 1 << 60)]
    return [first, second, third]


def steps(seq: Sequence, at: slice | np.ndarray, rows: list[list[np.ndarray]]) -> list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Weight rows, prior row and target of each softmax step for some of the tokens."""
    klass = seq.klass[at]
    group = klass >> 4
    first, second, third = ([f[at] for f in step] for step in rows)
    return [(first, np.zeros_like(klass), group), ([f + group for f in second], group, klass & 15), (third, klass, seq.bin[at])]


def priors(mass: np.ndarray) -> list[np.ndarray]:
    """Log shares of groups, of classes in a group and of bins in a class, from the mass of
    each class and bin: what the weights of the history start from."""
    bins = mass.reshape(CLASSES, WIDTH).astype(np.float64)
    out = [bins.sum(1).reshape(WIDTH, WIDTH).sum(1)[None], bins.sum(1).reshape(WIDTH, WIDTH), bins]
    return [np.log(x / x.sum(1, keepdims=True)).astype(np.float32) for x in out]


def _softmax(table: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    z = prior
    for r in rows:
        z = z + table[r]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


class Trainer:
    """AdaGrad over the tokens of one task, in batches; the prior is of the tokens so far."""

    def __init__(self) -> None:
        self.weights = [np.zeros((n, WIDTH), np.float32) for n in ROWS]
        self.squares = [np.ones((n, WIDTH), np.float32) for n in ROWS]
        self.mass = np.ones(CLASSES * WIDTH)
        self.tokens = 0

    def learn(self, seq: Sequence, chosen: np.ndarray) -> None:
        rows, chosen = features(seq), np.flatnonzero(chosen)
        self.tokens += len(chosen)
        for low in range(0, len(chosen), BATCH):
            at = chosen[low : low + BATCH]
            self.mass += np.bincount(seq.klass[at] * WIDTH + seq.bin[at], minlength=CLASSES * WIDTH)
            for level, (step, prior) in enumerate(zip(steps(seq, at, rows), priors(self.mass), strict=True)):
                self._step(level, step[0], prior[step[1]], step[2])

    def _step(self, level: int, rows: list[np.ndarray], prior: np.ndarray, target: np.ndarray) -> None:
        weights, squares = self.weights[level], self.squares[level]
        grad = _softmax(weights, rows, prior)
        grad[np.arange(len(target)), target] -= 1
        for r in rows:
            order = np.argsort(r.astype(np.uint16), kind="stable")
            ordered = r[order]
            start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            total = np.add.reduceat(grad[order], start, axis=0)
            row = ordered[start]
            squares[row] += total * total
            weights[row] -= RATE * total / np.sqrt(squares[row])


class Model(NamedTuple):
    """``share``: log10 of the denominator of a word's share in its bin, by class and bin."""

    weights: list[np.ndarray]
    prior: list[np.ndarray]
    share: np.ndarray
    tokens: int
    distinct: int

    def history_scores(self, seq: Sequence) -> np.ndarray:
        """log10 P(class and bin | history) of each token; the end has a class with one bin."""
        rows = features(seq)
        out = np.zeros(len(seq.token))
        for low in range(0, len(out), 4 * BATCH):
            part = slice(low, low + 4 * BATCH)
            each = np.arange(len(seq.klass[part]))
            for level, (own, before, target) in enumerate(steps(seq, part, rows)):
                p = np.log10(np.maximum(_softmax(self.weights[level], own, self.prior[level][before])[each, target].astype(np.float64), 1e-30))
                out[part] += np.where(seq.klass[part] == 0, 0.0, p) if level == 2 else p
        return out

    def score(self, seq: Sequence, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, model score) of each text; ``count``: each token's training count."""
        cut = seq.cut[:-1]
        plus = np.log10(count + 1.0)
        base = plus - np.log10(self.tokens + self.distinct + 1.0)
        own = self.history_scores(seq) + plus - self.share[seq.klass * WIDTH + seq.bin]
        return np.add.reduceat((count > 0).astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(own, cut)


def block_of(text: str, docs: int) -> Column:
    """The block of each row of a scan: neighbours whose texts are about as long.

    Texts of size class k have at most TEXT_BYTES * 2**k bytes and their blocks ``docs`` / 2**k
    rows, so that no block is over ``docs`` * TEXT_BYTES bytes, but for a longer text by itself.
    """
    over = F.expr(f"(octet_length({text}) - 1) div {TEXT_BYTES}")
    kind = F.when(over > 0, F.least(F.length(F.bin(over)), F.lit(docs.bit_length()))).otherwise(0)
    rows = F.greatest(F.call_function("shiftright", F.lit(docs), kind), F.lit(1))
    return F.call_function("div", F.monotonically_increasing_id(), rows) * 64 + kind


def _gather(docs: DataFrame) -> DataFrame:
    """One pass: per block the distinct tokens with their training counts, and per task its weights."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer()
        names = ["block", "token", "class", "n", "weights"]
        for batch in stream:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            trains = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
            for low, high, words in chunks(batch.column(2), NOT_SPACE):
                seq = sequence(words)
                size = np.diff(seq.cut)
                train = np.repeat(trains[low:high], size)
                if train.any():
                    trainer.learn(seq, train)
                for block in np.unique(blocks[low:high]):
                    own = np.repeat(blocks[low:high] == block, size)
                    found.setdefault(int(block), []).append(_distinct(seq.token[own], seq.klass[own], train[own].astype(np.int64)))
            for block, parts in found.items():
                token, klass, n = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for low in range(0, len(token), 100_000):
                    part = slice(low, low + 100_000)
                    size = len(token[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), pa.array(token[part]), pa.array(klass[part]), pa.array(n[part]), pa.nulls(size, pa.binary())], names)
        if trainer.tokens:
            packed = b"".join(w.astype(np.float16).tobytes() for w in trainer.weights)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([trainer.tokens]), pa.array([packed], pa.binary())], names)

    return docs.mapInArrow(batches, "block long, token long, class int, n long, weights binary")


def _distinct(token: np.ndarray, klass: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(token)
    ordered = token[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[start], klass[order][start], np.add.reduceat(n[order], start) if len(start) else n


def _averaged(weights: DataFrame, tasks: int) -> list[np.ndarray]:
    """The mean of all tasks' weights, by the tokens they saw: sums in about sqrt(tasks)
    tasks, then in one, each holding one running sum."""
    size = sum(ROWS) * WIDTH

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(size), 0
        for batch in stream:
            for packed, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(packed.as_buffer(), np.float16 if packed.as_buffer().size == 2 * size else np.float32).astype(np.float64) * n
                tokens += n
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "n"])

    parts = weights.repartition(max(1, int(tasks**0.5))).mapInArrow(add, "weights binary, n long")
    row = parts.repartition(1).mapInArrow(add, "weights binary, n long").first()
    flat = np.frombuffer(row["weights"], np.float32) if row else np.zeros(size, np.float32)
    return [x.reshape(-1, WIDTH) for x in np.split(flat, np.cumsum(ROWS)[:-1] * WIDTH)]


def train_and_score(df: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Train on the rows that ``trains`` marks and score every row's whole text.

    A-Z are lower-cased; tokens are words between ASCII white space and one end. Returns
    doc_id, trained, n_tokens, n_known, train_tokens, base_score (log10 of add-one
    unigram probabilities) and score (the model's log10 probability). Null text counts as
    empty: its end is its only token. A null mark does not train. Repeated rows count and
    are scored each; without training rows every count is 0; an empty table gives no
    rows; other columns are left out, whatever their names. Words are known by 64-bit
    hashes.

    Counts never meet in one place: each block of documents sends its distinct words,
    gets their counts back, and is scored next to them. Rows are known by their place in
    ``df``, which is read twice: give a scan of files, or a table written before.
    """
    marked = F.coalesce(trains, F.lit(False)).alias("trained")
    texts = df.select(marked, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    docs = texts.select(block_of("text", block_docs).alias("block"), "trained", "text", "doc_id")
    gathered = written(_gather(docs.select("block", "trained", "text")), "words")
    parts = gathered.filter("block is not null").select("block", "token", "class", "n")
    counts = parts.groupBy("token").agg(F.max("class").alias("class"), F.sum("n").alias("count"))

    def with_bins(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES * WIDTH, 2), np.int64)
        for batch in stream:
            token, klass, count = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = klass.astype(np.int64) * WIDTH + bin_of(token)
            np.add.at(sums, at, np.stack([count, count > 0], 1))
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used, 0]), pa.array(sums[used, 1])], ["bin", "n", "v"])

    by_bin = counts.select("token", "class", "count").mapInArrow(with_bins, "bin long, n long, v long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # one row per class and bin
    tasks = gathered.filter("weights is not null").select("weights", "n")
    tokens, distinct = sum(r["n"] for r in by_bin), sum(r["v"] for r in by_bin)
    mass = np.ones(CLASSES * WIDTH)
    for r in by_bin:
        # at the end of a text no other word is possible: its class has one member
        mass[r["bin"]] += r["n"] + (r["v"] if r["bin"] >= WIDTH else 0)
    model = df.sparkSession.sparkContext.broadcast(Model(_averaged(tasks, tasks.count()), priors(mass), np.log10(mass), tokens, distinct))  # 7 MB, whatever the input
    known = parts.select("block", "token").join(counts.select("token", "count"), "token")
    kind = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("token").to_numpy()
        order = np.argsort(key)
        key, count = key[order], known.column("count").to_numpy()[order]
        out = []
        for low, high, words in chunks(texts.column("text"), NOT_SPACE):
            seq = sequence(words)
            at = np.minimum(np.searchsorted(key, seq.token), max(0, len(key) - 1))
            if not (len(key) and (key[at] == seq.token).all()):
                raise RuntimeError("a block was read in other rows than before")
            n_known, base, own = model.value.score(seq, count[at])
            part = texts.slice(low, high - low)
            out.append(pa.table([part.column("doc_id").combine_chunks(), part.column("trained").combine_chunks(), pa.array(np.diff(seq.cut)), pa.array(n_known), pa.array(np.full(high - low, tokens, np.int64)), pa.array(base), pa.array(own)], names))
        empty = [texts.column("doc_id").slice(0, 0), texts.column("trained").slice(0, 0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.concat_tables(out) if out else pa.table(empty, names)

    return docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
