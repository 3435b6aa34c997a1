"""License scans by diagonal voting.

All rolling word k-grams of all texts are hashed and joined to the k-grams of the
templates. A match votes for its diagonal, the word at which the template would begin;
diagonals next to each other, as an inserted or lost word leaves them, are merged, and
a span counts once enough of the template's k-grams are found in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmetrics.llm.words import WORD_CHARS, chunks, mix64, split_words

GRAM = 3
#: Neighbouring diagonals of one template that far apart are one span, or an eighth of its k-grams if that is more.
SLACK = 2
#: Places that one long holds as bits.
WORD_BITS = 62


class Template(NamedTuple):
    """``covered``: the share of its k-grams that a span must hold; 1 where a single word,
    such as a version, tells licenses apart."""

    label: str
    text: str
    covered: float = 0.6


#: Every place where a phrase's words stand consecutively counts.
PHRASES = (Template("mit", "under the mit license", 1), Template("apache-2", "apache license version 2", 1), Template("cc-by-nc", "cc by nc", 1))
#: Notices and whole texts of well-known public licenses.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template(
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("apache-2", "licensed under the apache license version 2 0", 1),
    Template(
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template("gpl-3", "licensed under the gnu general public license version 3", 1),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", 1),
    Template("gpl-2", "licensed under the gnu general public license version 2", 1),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", 1),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template(
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special "
        "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
        "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised "
        "of the possibility of such damage",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
    ),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    Template("cc-by", "licensed under cc by 4 0", 1),
)


def _grams(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of k words a 64-bit hash to join on and 32 bits of another to check."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    joined = np.zeros(n, np.uint64)
    check = np.zeros(n, np.uint64)
    for i in range(k):
        joined = (joined ^ hashes[i : n + i]) * np.uint64(0xD6E8FEB86659FD93)
        check = check * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
    return mix64(joined).view(np.int64), (mix64(check) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _template_grams(templates: tuple[Template, ...], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in templates:
        raw = np.frombuffer(t.text.encode(), np.uint8)
        out.append(_grams(split_words(raw, np.array([0, len(raw)]), WORD_CHARS).hashes(), k))
        if not len(out[-1][0]):
            raise ValueError(f"a template needs {k} words at least: {t.text}")
    return out


def _template_rows(spark: SparkSession, grams: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Template k-grams with their places; id -1 stands for the row that each document sends itself."""
    rows = [(-1, 0, 0, 0)] + [(i, place, int(g), int(c)) for i, pair in enumerate(grams) for place, (g, c) in enumerate(zip(*pair, strict=True))]
    return spark.createDataFrame(rows, "template int, place int, gram long, check int")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES, k: int = GRAM, slack: int = SLACK) -> DataFrame:
    """License labels of every whole text.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.
    Returns doc_id, n_words, n_base (places of exact phrases), first_word and last_word
    (their least and greatest start, null without any), base_labels and labels (base
    ones and those of notices; distinct, sorted, joined by commas, '' if none) and score
    (the best share of a template found, 0 to 1). Null and empty text have no words.
    Repeated rows each give a row; an empty table gives none; other columns are left
    out, whatever their names.

    A span is a run of diagonals each within ``slack`` of the one before, or within an
    eighth of the template's k-grams if that is more. It is verified around its diagonal
    of most votes: the share of the template's places found within half the template's
    length of that diagonal, each place once, must reach ``covered``.

    The templates are a fixed list and are broadcast; only matches and one row per
    document are shuffled, and votes are summed before that, so a text of nothing but
    licenses, or a line that many texts share, costs no more than its matches. Places are
    bits of longs, one row for each WORD_BITS of them, so templates may be of any length.
    """
    spark = df.sparkSession
    templates = (*phrases, *notices)
    known = _template_grams(templates, k)
    kind = df.schema[id_col].dataType.simpleString()

    def grams(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_words", "pos", "gram", "check"]
        for batch in stream:
            for low, high, words in chunks(batch.column(2), WORD_CHARS):
                rows = high - low
                first, count = words.rows[:-1], np.diff(words.rows)
                hashes, checks = _grams(words.hashes(), k)
                owner = words.row_of()
                at = np.flatnonzero(np.arange(len(hashes)) + k <= words.rows[owner[: len(hashes)] + 1])
                own = owner[at]
                part = batch.slice(low, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count), pa.array(np.full(rows, -1)), pa.array(np.zeros(rows, np.int64)), pa.array(np.zeros(rows, np.int32))], names)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for i in range(0, len(at), 100_000):
                    a, o = at[i : i + 100_000], own[i : i + 100_000]
                    nothing = pa.nulls(len(a), part.column(1).type)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[o]), nothing, pa.nulls(len(a), pa.int64()), pa.array(a - first[o]), pa.array(hashes[a]), pa.array(checks[a])], names)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rolled = rows.mapInArrow(grams, f"row long, doc_id {kind}, n_words long, pos long, gram long, check int")
    votes = rolled.join(F.broadcast(_template_rows(spark, known)), ["gram", "check"])
    bits = F.expr(f"shiftleft(1L, place % {WORD_BITS})")
    diagonals = votes.groupBy("row", "template", (F.col("pos") - F.col("place")).alias("start"), F.expr(f"place div {WORD_BITS}").alias("word")).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("*").alias("n"), F.bit_or(bits).alias("places"))
    per_template = lambda values: F.get(F.array(*map(F.lit, values)), F.col("template"))
    whole = per_template([len(g) for g, _ in known])
    reach = F.coalesce(per_template([max(slack, len(g) // 8) for g, _ in known]), F.lit(slack))
    own = Window.partitionBy("row", "template")
    new = F.when(F.col("start") - F.lag("start").over(own.orderBy("start", "word")) <= reach, 0).otherwise(1)
    spans = diagonals.withColumn("new", new).withColumn("votes", F.sum("n").over(Window.partitionBy("row", "template", "start")))
    spans = spans.withColumn("span", F.sum("new").over(own.orderBy("start", "word").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("best", F.max(F.struct("votes", (-F.col("start")).alias("back"))).over(Window.partitionBy("row", "template", "span")))
    near = F.abs(F.col("start") + F.col("best.back")) <= F.greatest(reach, whole / 2)
    exact = (F.col("template") >= 0) & (F.col("template") < len(phrases)) & (F.col("votes") == whole) & (F.col("word") == 0)
    words = spans.groupBy("row", "template", "span", "word").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.bit_count(F.coalesce(F.bit_or(F.when(near, F.col("places"))), F.lit(0).cast("long"))).alias("found"),
        F.count_if(exact).alias("n_base"), F.min(F.when(exact, F.col("start"))).alias("first_word"), F.max(F.when(exact, F.col("start"))).alias("last_word"),
    )
    spans = words.groupBy("row", "template", "span").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("found").alias("found"), F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
    )
    found = F.when(F.col("template") >= 0, F.col("found") / whole).otherwise(0.0)
    named = (F.col("n_base") > 0) | ((F.col("template") >= len(phrases)) & (found >= per_template([float(t.covered) for t in templates])))
    label = per_template([t.label for t in templates])
    docs = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.collect_set(F.when(F.col("n_base") > 0, label)).alias("base"), F.collect_set(F.when(named, label)).alias("all"), F.max(F.when(named, found).otherwise(0.0)).alias("score"),
    )
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return docs.select("doc_id", "n_words", F.col("n_base").cast("long").alias("n_base"), "first_word", "last_word", listed("base").alias("base_labels"), listed("all").alias("labels"), "score")
