"""Token counts of texts under a given BPE vocabulary, without encoding most of them.

Which strings of the vocabulary are encoded alone as one token is proved once, before
any text is read: a string counts as whole if it is one piece under the vocabulary's own
normal form and its merges end in that one token. Texts are then cut into words; a word
that is a whole token counts 1 by a look into that table, and only pieces beyond it are
merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm import pretokens
from callmetrics.llm.bpe import Vocabulary, vocabulary
from callmetrics.llm.words import slices

#: Documents of more tokens than this are over the limit.
LIMIT = 2048
#: A text is worked on in parts of about so many characters, cut before a space.
PART_CHARS = 1 << 20
#: A worker keeps the counts of words of at most so many characters, about so many bytes of them.
KEPT_CHARS = 64
KEPT_BYTES = 32 << 20
#: About what an entry takes beside its characters.
ENTRY_BYTES = 160


def whole_tokens(vocab: Vocabulary) -> list[str]:
    """The strings that the vocabulary proves to encode alone as one token.

    A candidate is the text that a token spells. It must come through the normal form
    unchanged as one word and one piece, and its merges must leave one part. Strings that
    other merges cut differently, that are no valid UTF-8 or only occur inside words
    fail the proof and stay out.
    """
    proved = []
    for text in vocab.spelled():
        if pretokens.words(text) == [text] and pretokens.pieces(text) == [text] and len(vocab.piece(text.encode())) == 1:
            proved.append(text)
    return proved


class Counter(dict):
    """Tokens of a word without white space: whole tokens from the proved table, other
    words by their pieces, kept as long as they and their keys take few bytes."""

    def __init__(self, vocab: Vocabulary, proved: list[str]) -> None:
        super().__init__(dict.fromkeys(proved, 1))
        self.vocab, self.proved, self.room = vocab, frozenset(proved), KEPT_BYTES

    def __missing__(self, word: str) -> int:
        count = 0
        for piece in pretokens.pieces(word):
            count += 1 if piece in self.proved else len(self.vocab.piece(piece.encode()))
        if len(word) <= KEPT_CHARS:
            if self.room <= 0:
                self.clear()
                self.update(dict.fromkeys(self.proved, 1))
                self.room = KEPT_BYTES
            self[word] = count
            self.room -= ENTRY_BYTES + 4 * len(word)
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, a part at a time: white space ends a
        word, and nothing composes across it."""
        count, low = 0, 0
        while low < len(text):
            high = len(text) if len(text) - low <= PART_CHARS else text.find(" ", low + PART_CHARS)
            high = len(text) if high < 0 else high
            count += sum(map(self.__getitem__, pretokens.words(text[low:high])))
            low = high
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text; strings of special tokens inside it are one token each."""
        cut = self.vocab.cut
        if cut is None or cut.search(text) is None:
            return self.plain(text)
        return sum(1 if part in self.vocab.special else self.plain(part) for part in cut.split(text))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """How many tokens each whole text has.

    Returns the id as ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, and ``over_limit``
    (more than ``limit`` tokens). Rows stay in their tasks: no shuffle. Null and empty
    texts have none; repeated rows each give a row; other columns are left out, whatever
    their names. The proved table is broadcast: it holds strings of the vocabulary only,
    so it cannot grow with the data. ``path`` must name the vocabulary file on every
    executor.
    """
    kind = df.schema[id_col].dataType.simpleString()
    proved = df.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary(path)))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path), proved.value)
        for batch in stream:
            for part in slices(batch, 1, 1024):
                counts = [counter.count(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
