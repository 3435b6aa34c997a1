"""Toxicity by a classifier chain over hashed words.

Categories are predicted one after another. The linear model of each sees the hashed
words of a text and the probabilities of all earlier categories, as log odds; in training, those
come from models that did not see the row (out of fold), so later models learn from
predictions as uncertain as those they will meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.samples import bounded_sample
from callmetrics.llm.storage import written
from callmetrics.llm.words import WORD_CHARS, chunks

BITS = 18
#: Bound on the labelled rows of each combination of labels that the chain is fitted on.
ROWS_PER_LABEL = 3000
FOLDS = 3
STEPS = 300
#: Words of fewer texts of the sample tell nothing.
LEAST_ROWS = 3
SMOOTHING = 4.0
PENALTY = 1e-4
#: No category is given below this probability.
LEAST_THRESHOLD = 0.35
#: Occurrences of a word in one text beyond this count no more.
MOST = 3


class LinearModel(NamedTuple):
    """Weights of the word buckets, then of the earlier categories' log odds; a bias; and the threshold."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float


class Chain(NamedTuple):
    categories: list[str]
    models: list[LinearModel]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """P of each category for each whole text of a string column."""
        out = np.zeros((len(column), len(self.models)))
        for low, high, words in chunks(column, WORD_CHARS):
            row, bucket, count = _features(words)
            odds = np.zeros((high - low, 0))
            for j, m in enumerate(self.models):
                z = np.bincount(row, m.words[bucket] * count, high - low) + odds @ m.earlier + m.bias
                out[low:high, j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                odds = np.column_stack([odds, np.clip(z, -6, 6)])
        return out


def _features(words: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, occurrences up to MOST) of the distinct words of each row."""
    bucket = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    keys, count = np.unique(words.row_of() << BITS | bucket, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), np.minimum(count, MOST).astype(np.float64)


def _fit(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated gradient steps. Words of fewer than LEAST_ROWS
    texts are left out. The others are scaled by the log odds of their texts against
    those of all, smoothed by SMOOTHING texts, so that words of few texts, or of both
    classes alike, start small and, as no step is scaled by feature, stay behind."""
    n = len(y)
    if not 0 < y.sum() < n:
        return np.zeros(1 << BITS), np.zeros(earlier.shape[1]), 12.0 if y.sum() else -12.0
    used, at, texts = np.unique(bucket, return_inverse=True, return_counts=True)
    often = texts[at] >= LEAST_ROWS
    row, at, count = row[often], at[often], count[often]
    share = y.mean()
    pos = np.bincount(at, y[row], len(used))
    ratio = np.log((pos + SMOOTHING * share) / (texts - pos + SMOOTHING * (1 - share))) - np.log(share / (1 - share))
    value = count * ratio[at]
    width = len(used) + earlier.shape[1] + 1

    def scores(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[at] * value, n) + earlier @ v[len(used) : -1] + v[-1]

    def back(g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, value * g[row], len(used)), earlier.T @ g, [g.sum()]])

    top = np.ones(width) / np.sqrt(width)
    for _ in range(20):  # the largest eigenvalue bounds the step
        top = back(scores(top)) / n
        largest = float(np.linalg.norm(top))
        top /= max(largest, 1e-12)
    step = 1 / (0.3 * largest + PENALTY)
    now, ahead = np.zeros(width), np.zeros(width)
    now[-1] = ahead[-1] = np.log(share / (1 - share))
    for i in range(STEPS):
        z = scores(ahead)
        grad = back((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n)
        grad[:-1] += PENALTY * ahead[:-1]
        before, now = now, ahead - step * grad
        ahead = now + i / (i + 3) * (now - before)
    out = np.zeros(1 << BITS)
    out[used] = now[: len(used)] * ratio * (texts >= LEAST_ROWS)
    return out, now[len(used) : -1], float(now[-1])


def _unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(frame)), [len(x) // 4 for x in frame["bucket"]])
    return row, np.frombuffer(b"".join(frame["bucket"]), np.int32).astype(np.int64), np.frombuffer(b"".join(frame["count"]), np.uint8).astype(np.float64)


def _trainer(j: int, held: dict[str, np.ndarray]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Fits category ``j`` given the earlier categories' log odds out of fold, by doc_id."""

    def earlier(frame: pd.DataFrame) -> np.ndarray:
        return np.array([held[str(k)] for k in frame["doc_id"]]).reshape(len(frame), j) if j else np.zeros((len(frame), 0))

    def train(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Fits on all folds but ``key``; returns the model and the held-out log odds."""
        own = frame[frame["fold"] != key[0]].sort_values("doc_id")
        w, e, b = _fit(*_unpack(own), earlier(own), own[f"y{j}"].to_numpy(np.float64))
        rest = frame[frame["fold"] == key[0]]
        row, bucket, count = _unpack(rest)
        z = np.bincount(row, w[bucket] * count, len(rest)) + earlier(rest) @ e + b
        return pd.DataFrame({"fold": [key[0]], "model": [np.concatenate([w, e, [b]]).tobytes()], "ids": [[str(k) for k in rest["doc_id"]]], "z": [list(map(float, z))], "y": [rest[f"y{j}"].astype(int).tolist()]})

    return train


def fit_chain(df: DataFrame, labels: DataFrame, categories: dict[str, Column], rows_per_label: int = ROWS_PER_LABEL, folds: int = FOLDS) -> Chain:
    """A chain over ``categories`` (name to boolean column of ``labels``, in order).

    ``df`` holds doc_id and text, ``labels`` doc_id and what the columns need. At most
    ``rows_per_label`` labelled rows of each combination of labels teach it, chosen by a
    hash of doc_id; their whole texts are used. Nulls among ids and labels teach
    nothing; of labels that repeat an id the greatest counts, of texts the least. Without rows, or with one class only, a category gets its constant.
    Each fit runs in a task over that bounded sample; the out-of-fold fits run side by
    side. The threshold of a category is the one of best F1 out of fold, at
    least LEAST_THRESHOLD.
    """
    names = list(categories)
    known = labels.select("doc_id", *(c.cast("int").alias(n) for n, c in categories.items())).dropna().groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    combined = known.withColumn("__labels", F.concat_ws("", *(F.col(n).cast("string") for n in names)))
    chosen = bounded_sample(combined.select("doc_id", "__labels"), "__labels", rows_per_label)
    # bounded by rows_per_label for each combination
    chosen = chosen.select("doc_id", *(F.substring("__labels", i + 1, 1).cast("int").alias(f"y{i}") for i in range(len(names))))
    sample = df.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))))

    def features(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for low, high, words in chunks(batch.column("text"), WORD_CHARS):
                row, bucket, count = _features(words)
                cut = np.searchsorted(row, np.arange(high - low + 1))
                part = batch.slice(low, high - low)
                packed = [pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]) for v in (bucket.astype(np.int32), count.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(f"y{i}") for i in range(len(names))), *packed], ["doc_id", *(f"y{i}" for i in range(len(names))), "bucket", "count"])

    kind = df.schema["doc_id"].dataType.simpleString()
    ys = ", ".join(f"y{i} int" for i in range(len(names)))
    sample = written(sample.mapInArrow(features, f"doc_id {kind}, {ys}, bucket binary, count binary"), "toxicity")
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("bucket", F.lit(3)), F.lit(folds)).cast("int"))  # copies share a fold
    models: list[LinearModel] = []
    odds: dict[str, np.ndarray] = {}  # by doc_id: log odds out of fold, for the sample only
    for j in range(len(names)):
        copies = sample.withColumn("leave", F.explode(F.array(*map(F.lit, range(-1, folds)))))
        fitted = copies.groupBy("leave").applyInPandas(_trainer(j, dict(odds)), "fold int, model binary, ids array<string>, z array<double>, y array<int>").collect()
        whole = next((np.frombuffer(r["model"]) for r in fitted if r["fold"] == -1), np.concatenate([np.zeros((1 << BITS) + j), [-12.0]]))
        z = np.array([x for r in fitted if r["fold"] >= 0 for x in r["z"]])
        y = np.array([x for r in fitted if r["fold"] >= 0 for x in r["y"]])
        ids = [x for r in fitted if r["fold"] >= 0 for x in r["ids"]]
        for i, x in zip(ids, z, strict=True):
            odds[i] = np.append(odds.get(i, np.zeros(0)), np.clip(x, -6, 6))
        models.append(LinearModel(whole[: 1 << BITS], whole[1 << BITS : -1], float(whole[-1]), _threshold(z, y)))
    return Chain(names, models)


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The probability that splits out-of-fold rows with the best F1, the middle of the gap
    there, but at least LEAST_THRESHOLD: texts of unknown words stay clean."""
    if not len(z) or not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-z)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    best = int(f1.argmax())
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best]
    return max(LEAST_THRESHOLD, float(1 / (1 + np.exp(-np.clip((z[order][best] + below) / 2, -40, 40)))))


def classify(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of every row, and for each category its probability ``p_<name>`` and the
    decision ``<name>``.

    Whole texts are read. Null and empty texts have no words and get what the chain says
    of none. Repeated rows each give a row; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    columns = [f"{prefix}{n} {t}" for n in chain.categories for prefix, t in (("p_", "double"), ("", "boolean"))]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            p = chain.probabilities(batch.column(1))
            made = [pa.array(x) for j, m in enumerate(chain.models) for x in (p[:, j], p[:, j] >= m.threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *(c.split()[0] for c in columns)])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, " + ", ".join(columns))


def without(df: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that the chain does not put in ``category``."""
    at, j = df.columns.index(text_col), chain.categories.index(category)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pa.array(chain.probabilities(batch.column(at))[:, j] < chain.models[j].threshold))

    return df.mapInArrow(batches, df.schema)
