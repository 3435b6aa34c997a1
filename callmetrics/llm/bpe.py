"""Byte-pair encoding and decoding with a given vocabulary file.

The vocabulary (JSON: ``model.vocab``, ``model.merges``, an end-of-word suffix,
``added_tokens``) is read once per Python worker from the path given; nothing is
trained. A text is put in NFC, lower-cased, cut into contractions, runs of letters,
single digits and runs of other signs, and each piece becomes bytes whose last one
carries the end-of-word mark. The merge loop works on a contiguous array: the parts
of a short word and the ranks of its adjacent pairs lie side by side, the least rank
is searched for again and again, its boundary is deleted and the two ranks beside it
are refreshed. Long pieces, where that search would be quadratic, take a heap over
the same ranks and give the same parts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm import pretokens
from callmetrics.llm.words import slices

#: Pieces of more bytes than this are merged with a heap.
SHORT_BYTES = 128
#: A worker keeps the encodings of strings of at most so many characters, as long as they and
#: their encodings take about so many bytes, and as many bytes of older ones.
KEPT_CHARS = 64
KEPT_BYTES = 24 << 20
#: About what an entry takes beside its characters, ids and tokens.
ENTRY_BYTES = 320
NO_PAIR = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    visible Latin-1 signs stand for themselves, the other bytes take U+0100 upwards."""
    visible = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ranks of adjacent parts, and texts to ids and back."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids: dict[str, int] = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.suffix = suffix
        self.inner = [ids[letters[b]] for b in range(256)]
        self.last = [ids[letters[b] + suffix] for b in range(256)]
        #: By the left part: the rank of its pair with each right part; by rank: the part they make.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left]].setdefault(ids[right], rank)
            self.made.append(ids[left + right])
        self.tokens = {i: token for token, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.room = KEPT_BYTES

    def spelled(self) -> list[str]:
        """The texts that tokens with the end-of-word mark spell, where they are valid UTF-8."""
        byte_of = {letter: b for b, letter in byte_letters().items()}
        found = []
        for token in self.tokens.values():
            if self.suffix and token.endswith(self.suffix) and token not in self.special:
                try:
                    found.append(bytes(byte_of[x] for x in token[: -len(self.suffix)]).decode())
                except (KeyError, UnicodeDecodeError):  # a part of a letter, or no byte letters
                    continue
        return found

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        return self._scan(parts) if len(parts) <= SHORT_BYTES else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        of, made = self.ranks, self.made
        ranks = [of[a].get(b, NO_PAIR) for a, b in pairwise(parts)]
        while ranks and (least := min(ranks)) != NO_PAIR:
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = of[parts[i - 1]].get(new, NO_PAIR)
            if i < len(ranks):
                ranks[i] = of[new].get(parts[i + 1], NO_PAIR)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks[parts[i]].get(parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def word(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, decoded tokens) of a string without white space."""
        if (found := self.older.get(text)) is None:
            pieces = pretokens.pieces(text)
            if len(pieces) > 1:
                made = [self.kept.get(p) or self.word(p) for p in pieces]
                found = b"".join([m[0] for m in made]), b" ".join([m[1] for m in made])
            else:
                ids = self.piece(text.encode())
                found = array("I", ids).tobytes(), " ".join([self.tokens[i] for i in ids]).encode()
        if len(text) <= KEPT_CHARS:
            if self.room <= 0:
                self.older, self.kept, self.room = self.kept, {}, KEPT_BYTES
            self.kept[text] = found
            self.room -= ENTRY_BYTES + 4 * len(text) + len(found[0]) + len(found[1])
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, the decoded text in UTF-8)."""
        if self.cut is None or "<" not in text:
            parts = self._plain(text)
        else:
            parts = []
            for piece in self.cut.split(text):
                if piece in self.special:
                    parts.append((self.special[piece].to_bytes(4, "little"), piece.encode()))
                else:
                    parts += self._plain(piece)
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def _plain(self, text: str) -> list[tuple[bytes, bytes]]:
        word = self.word
        return [self.kept.get(w) or word(w) for w in pretokens.words(text)]

    def decode(self, ids: list[int]) -> str:
        """Tokens as the vocabulary spells them, joined by one space, special ones too."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text, then decode its ids.

    Returns the id, ``n_tokens``, and ``ids`` (array of int) with ``decoded``
    (string); with ``digests`` the SHA-256 of both in their place. Rows stay apart and
    in their tasks: no shuffle. Null and empty text have no tokens and decode to ''.
    Repeated rows each give a row; other columns are left out, whatever their names.
    ``path`` must name the vocabulary file on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in stream:
            for part in slices(batch, 1, 256):
                made = [vocab.encode(t or "") for t in part.column(1).to_pylist()]
                count = pa.array([len(ids) // 4 for ids, _ in made], pa.int64())
                if digests:
                    more = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in made]) for k in (0, 1)]
                else:
                    more = [pa.array([memoryview(ids).cast("I").tolist() for ids, _ in made], pa.list_(pa.int32())), pa.array([d.decode() for _, d in made])]
                yield pa.RecordBatch.from_arrays([part.column(0), count, *more], ["doc_id", "n_tokens", *(x.split()[0] for x in tail.split(", "))])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, n_tokens long, {tail}")
