"""Language identification with interpolated Kneser-Ney character models.

One model per language, all kept in sorted arrays of n-gram hashes: a row holds the
log probability of the n-gram's last character in every language, back-off included,
so that a character takes one search. The language with the lowest cross-entropy per
character is chosen, and a text is rejected whose cross-entropy lies outside what
texts of that language and length had when the thresholds were calibrated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.samples import bounded_sample
from callmetrics.llm.storage import written
from callmetrics.llm.words import mix64, slices

ORDER = 4
#: Bound on the labelled documents of one language that models are fitted on.
DOCS_PER_LANGUAGE = 1500
#: Parts of these; each calibrates rejection by models that the others taught.
FOLDS = 5
#: Share of the documents by which the allowance for short texts is set.
KEPT = 0.99
#: Characters that are scored at once, so that a text of any length takes bounded memory.
PIECE = 1 << 18
#: Bits a character above the mean that any length may have.
SLACK = 1.5
SPACE = 32
_FACTOR = np.uint64(0x100000001B3)


def _fold_table() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    table = np.full(0x110000, SPACE, np.int32)
    for code in range(0x323B0):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_FOLD: list[np.ndarray] = []


def characters(text: str | None, order: int) -> np.ndarray:
    """Lower-case letters of a whole text with one space for each run of others, padded
    with order - 1 spaces in front and one behind; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int32)
    if not _FOLD:
        _FOLD.append(_fold_table())
    folded = _FOLD[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    letter = folded != SPACE
    if not letter.any():
        return np.zeros(0, np.int32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.concatenate([np.full(order - 1, SPACE, np.int32), folded[keep], np.full(1, SPACE, np.int32)])
    return out[:-1] if out[-2] == SPACE else out


def _hash_grams(chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams; entry i ends at character i + n - 1."""
    h = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for i in range(n):
        h = (h + chars[i : len(chars) - n + 1 + i].astype(np.uint64) + np.uint64(1)) * _FACTOR
    return mix64(h)


class Level(NamedTuple):
    """Sorted hashes of n-grams of one length, a log2 value of each by language, and where
    the hashes with each leading 16 bits start."""

    keys: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, value: np.ndarray) -> Level:
        return cls(keys, value, np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, if it is there."""
        last = len(self.keys) - 1
        at = np.minimum(self.start[(keys >> np.uint64(48)).astype(np.int32)], last)
        found = self.keys[at]
        moving = np.flatnonzero((found < keys) & (at < last))
        while len(moving):  # hashes are even, so a start is a step or two away
            at[moving] += 1
            now = self.keys[at[moving]]
            moving = moving[(now < keys[moving]) & (at[moving] < last)]
        return at, self.keys[at] == keys


class Models(NamedTuple):
    languages: list[str]
    order: int
    #: Probabilities of n-grams of 1, 2, ... characters; back-off weights of contexts of as many.
    levels: list[Level]
    contexts: list[Level]
    unknown: float
    #: By language: limit of the cross-entropy, and what a text of n characters may have above it: width / sqrt(n).
    mean: np.ndarray
    width: np.ndarray

    def log_probs(self, chars: np.ndarray) -> np.ndarray:
        """log2 P of each character after the padding, by language."""
        n = len(chars) - self.order + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for k in range(self.order, 0, -1):
            grams = _hash_grams(chars[self.order - k :], k)[left]
            at, hit = self.levels[k - 1].find(grams)
            out[left[hit]] += self.levels[k - 1].value[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if k > 1:  # the context is the gram without its last character
                context = _hash_grams(chars[self.order - k : -1], k - 1)[left]
                at, hit = self.contexts[k - 2].find(context)
                out[left[hit]] += self.contexts[k - 2].value[at[hit]]
        out[left] += self.unknown
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy by language) of each text; 0 characters without letters."""
        count, bits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if held:
                # texts are padded, so no n-gram that ends past a text's padding crosses into another
                whole = np.concatenate([c for _, c in held])
                probs = self.log_probs(whole)
                end = np.cumsum([len(c) for _, c in held])
                for (i, c), stop in zip(held, end, strict=True):
                    count[i] += len(c) - self.order + 1
                    bits[i] -= probs[stop - len(c) : stop - self.order + 1].sum(0, dtype=np.float64)
                held.clear()

        for i, text in enumerate(texts):
            chars = characters(text, self.order)
            for low in range(0, len(chars) - self.order + 1, PIECE):  # pieces share order - 1 characters, so each n-gram is in one
                held.append((i, chars[low : low + PIECE + self.order - 1]))
                size += len(held[-1][1])
                if size > PIECE:
                    flush()
                    size = 0
        flush()
        return count, bits / np.maximum(count, 1)[:, None]

    def choose(self, count: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, posterior probability of it given the whole text, within the calibrated limit)."""
        best = bits.argmin(1)
        weight = np.exp2(-(bits - bits.min(1, keepdims=True)) * count[:, None])
        share = 1.0 / weight.sum(1)
        limit = self.mean[best] + self.width[best] / np.sqrt(np.maximum(count, 1))
        return best, share, (count > 0) & (bits[np.arange(len(best)), best] <= limit)


def _counted(texts: Iterable[str], order: int) -> pd.DataFrame | None:
    """Counts of the n-grams of full length, as code points; None without letters."""
    names = [f"c{i}" for i in range(order)]
    grams = [np.lib.stride_tricks.sliding_window_view(c, order) for c in (characters(t, order) for t in texts) if len(c)]
    if not grams:
        return None
    return pd.DataFrame(np.concatenate(grams), columns=names).groupby(names, sort=False).size().reset_index(name="n")


def _grams_of(sample: DataFrame, order: int) -> DataFrame:
    """Counts of the n-grams of full length by language and fold, as code points."""
    names = [f"c{i}" for i in range(order)]

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lang, fold, text = (pd.Series(batch.column(c).to_pylist()) for c in ("lang", "fold", "text"))
            for (one, part), texts in text.groupby([lang, fold]):
                frame = _counted(texts, order)
                if frame is None:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(frame)), pa.array([part] * len(frame), pa.int32()), *(pa.array(frame[c].to_numpy(np.int32)) for c in names), pa.array(frame["n"].to_numpy(np.int64))], ["lang", "fold", *names, "n"])

    parts = sample.select("lang", "fold", "text").mapInArrow(count, "lang string, fold int, " + ", ".join(f"{c} int" for c in names) + ", n long")
    return parts.groupBy("lang", "fold", *names).agg(F.sum("n").alias("n"))


def _kneser_ney(counts: pd.DataFrame, languages: list[str], order: int, letters: int | None = None) -> tuple[list[Level], list[Level], float]:
    """Interpolated Kneser-Ney, written as back-off: seen n-grams hold the interpolated
    probability, contexts the weight of the shorter one. Below full length, counts are
    of distinct characters in front. ``letters``: size of the alphabet, if not that of
    ``counts``."""
    names = [f"c{i}" for i in range(order)]
    alphabet = pd.unique(counts[names].to_numpy().ravel())
    unknown = -float(np.log2((letters or len(alphabet)) + 1))
    tables: list[dict[str, pd.DataFrame]] = [{} for _ in range(order)]
    for lang in languages:
        now = counts.loc[counts["lang"] == lang, [*names, "n"]]
        for k in range(order, 0, -1):
            tables[k - 1][lang] = now
            if k > 1:
                now = now.groupby(list(now.columns[1:-1])).size().reset_index(name="n")
    floors: dict[str, float] = {}
    lower: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # by language: sorted hashes and probabilities one shorter
    backs: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    probs: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]

    def hashes(columns: np.ndarray) -> np.ndarray:
        h = np.zeros(len(columns), np.uint64)
        for i in range(columns.shape[1]):
            h = (h + columns[:, i].astype(np.uint64) + np.uint64(1)) * _FACTOR
        return mix64(h)

    for lang in languages:
        for k in range(1, order + 1):
            table = tables[k - 1][lang]
            grams, n = table.iloc[:, :-1].to_numpy(), table["n"].to_numpy(np.float64)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
            context, which = np.unique(hashes(grams[:, :-1]), return_inverse=True)
            total = np.bincount(which, n, len(context))
            weight = discount * np.bincount(which, minlength=len(context)) / total
            if k == 1:
                shorter = np.full(len(n), 2.0**unknown)
            else:
                keys, p = lower[lang]
                shorter = p[np.searchsorted(keys, hashes(grams[:, 1:]))]
                backs[k - 2][lang] = (context, np.log2(weight))
            p = np.maximum(n - discount, 0) / total[which] + weight[which] * shorter
            keys = hashes(grams)
            by = np.argsort(keys)
            lower[lang] = (keys[by], p[by])
            probs[k - 1][lang] = (keys[by], np.log2(p[by]))
            if k == 1:
                floors[lang] = float(np.log2(weight[0])) + unknown
    levels: list[Level] = []
    contexts: list[Level] = []
    for k in range(order):
        for tables_of, out, missing in ((probs[k], levels, np.nan), (backs[k], contexts, 0.0)):
            if not tables_of:
                continue
            every = np.unique(np.concatenate([tables_of[x][0] for x in languages]))
            value = np.full((len(every), len(languages)), missing, np.float32)
            for j, lang in enumerate(languages):
                keys, own = tables_of[lang]
                value[np.searchsorted(every, keys), j] = own
            out.append(Level.of(every, value))
    # an n-gram that only other languages saw gets its back-off probability here
    for k in range(order):
        grams = pd.concat([tables[k][x].iloc[:, :-1] for x in languages]).drop_duplicates().to_numpy()
        at = np.searchsorted(levels[k].keys, hashes(grams))
        for j, lang in enumerate(languages):
            missing = np.isnan(levels[k].value[at, j])
            if k == 0:
                levels[0].value[at[missing], j] = floors[lang]
                continue
            rows = grams[missing]
            context, known = contexts[k - 1].find(hashes(rows[:, :-1]))
            shorter, _ = levels[k - 1].find(hashes(rows[:, 1:]))
            levels[k].value[at[missing], j] = levels[k - 1].value[shorter, j] + np.where(known, contexts[k - 1].value[context, j], 0)
    return levels, contexts, min(floors.values())


def _cross_fitted(sample: DataFrame, grams: DataFrame, order: int, letters: int) -> DataFrame:
    """(lang, n, bits) of every document of the sample with letters, scored by a model of
    its language that the other folds taught. Each fold of a language is a task."""
    names = [f"c{i}" for i in range(order)]
    held = F.explode(F.array(*map(F.lit, range(FOLDS)))).alias("held")
    others = grams.select("*", held).filter("held <> fold").groupBy("lang", "held", *names).agg(F.sum("n").alias("n"))

    def score(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(counts):
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "n": np.zeros(0, np.int64), "bits": np.zeros(0)})
        lang = rows["lang"].iloc[0]
        levels, contexts, unknown = _kneser_ney(counts[["lang", *names, "n"]], [lang], order, letters)
        n, bits = Models([lang], order, levels, contexts, unknown, np.zeros(1), np.zeros(1)).score(rows["text"].tolist())
        return pd.DataFrame({"lang": [lang] * int((n > 0).sum()), "n": n[n > 0], "bits": bits[n > 0, 0]})

    rows = sample.select("lang", "fold", "text").groupBy("lang", "fold")
    return rows.cogroup(others.groupBy("lang", "held")).applyInPandas(score, "lang string, n long, bits double")


def fit(df: DataFrame, trains: Column | None = None, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE) -> Models:
    """Models from ``df`` (doc_id, text, lang): whole texts of at most
    ``docs_per_language`` documents of each language, chosen by a hash of doc_id.

    Rows with a null in any of the three teach nothing, nor do those whose language is
    ``und``; ``trains`` narrows the rest. All documents of a language teach it, and all
    calibrate its limit of rejection, by cross-fitting in FOLDS parts: SLACK bits above
    the mean cross-entropy seen there, and by length what KEPT of all documents exceeded
    their language's mean by at most (times the root of their length), with half of it
    again. The limits are wide: known languages stay, other scripts and letter noise go.
    A language that cannot be cross-fitted (a single document) has the median limit of
    the others, at most the bits of an even draw from the alphabet.
    """
    usable = df.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null and lang <> 'und'")
    if trains is not None:
        usable = usable.filter(trains)
    chosen = bounded_sample(usable.select("doc_id", "lang"), "lang", docs_per_language)
    # bounded by docs_per_language; of rows that repeat an id the one with the least language and text teaches
    own = usable.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    own = own.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("least")).select("doc_id", "least.text", "least.lang")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))
    sample = written(own.withColumn("fold", F.pmod(nth, F.lit(FOLDS)).cast("int")), "languages")
    grams = written(_grams_of(sample, order), "grams")
    names = [f"c{i}" for i in range(order)]
    # bounded by the sample
    counts = grams.groupBy("lang", *names).agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return Models([], order, [], [], 0.0, np.zeros(0), np.zeros(0))
    levels, contexts, unknown = _kneser_ney(counts, languages, order)
    letters = len(pd.unique(counts[names].to_numpy().ravel()))
    mean, excess, alone = np.full(len(languages), np.log2(letters + 1)), [np.ones(1)], []
    seen = _cross_fitted(sample, grams, order, letters).toPandas().sort_values(["lang", "n", "bits"])  # two numbers a document of the sample
    for j, lang in enumerate(languages):
        own_seen = seen[seen["lang"] == lang]
        if not len(own_seen):
            alone.append(j)
            continue
        bits = own_seen["bits"].to_numpy(np.float64)
        mean[j] = bits.mean() + SLACK
        excess.append((bits - bits.mean()) * np.sqrt(own_seen["n"].to_numpy(np.float64)))
    if len(alone) < len(languages):
        mean[alone] = np.minimum(mean[alone], np.median(np.delete(mean, alone)))
    width = 1.5 * max(1.0, float(np.quantile(np.concatenate(excess), KEPT))) + 5
    return Models(languages, order, levels, contexts, unknown, mean, np.full(len(languages), width))


def identify(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every whole text.

    ``lang_pred`` is the language of lowest cross-entropy per character and ``score`` its
    posterior among all, each as likely before (1 beyond doubt); ``accepted`` is false where the cross-entropy lies
    beyond the calibrated limit. Null, empty and letterless texts are ``und`` with score
    0, not accepted. Repeated rows each give a row; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, 1, 512):
                pred, share, accepted = predict(models, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(share), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def predict(models: Models, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    if not models.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    count, bits = models.score(texts)
    best, share, accepted = models.choose(count, bits)
    return [models.languages[b] if n else "und" for b, n in zip(best, count, strict=True)], np.where(count > 0, share, 0.0), accepted


def accepted_only(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text is in a known language."""
    at = df.columns.index(text_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, at, 512):
                yield part.filter(pa.array(predict(models, part.column(at).to_pylist())[2]))

    return df.mapInArrow(batches, df.schema)
