"""Fill-in-the-middle: texts cut at two line boundaries and put in another order.

A text is laid out in blocks of a fixed number of bytes. A Fenwick tree over the blocks
holds how many units (lines) end in each and how many code points begin in each. Where
the k-th unit ends is found by descending the tree by halves to its block, then by
looking within that block alone; the same tree tells the code points before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.words import slices, text_bytes

#: Bytes of a block.
BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of these the percent that begin with the suffix.
RATE, SPM_RATE = 100, 50
SEED = 7
NEWLINE = 0x0A


class Fenwick:
    """Prefix sums of two counts a block: units that end in it and code points that begin in it."""

    def __init__(self, units: np.ndarray, points: np.ndarray) -> None:
        self.size = len(units)
        self.units, self.points = self._built(units), self._built(points)
        self.top = 1 << (self.size.bit_length() - 1) if self.size else 0

    @staticmethod
    def _built(counts: np.ndarray) -> np.ndarray:
        """Node i holds the sum of the i & -i blocks that end with block i."""
        upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        i = np.arange(len(upto))
        return upto - upto[i - (i & -i)]

    def descend(self, unit: int) -> tuple[int, int, int]:
        """(block, units before it, code points before it) of the block where the ``unit``-th unit ends."""
        at, units, points, step = 0, 0, 0, self.top
        while step:
            further = at + step
            if further <= self.size and units + self.units[further] < unit:
                at, units, points = further, units + int(self.units[further]), points + int(self.points[further])
            step >>= 1
        return at, units, points


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, np.arange(0, len(flags), BLOCK), dtype=np.int64)


class Lines:
    """The lines of one text in UTF-8: each ends with its line feed, the last perhaps without."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        ends = data == NEWLINE
        begins = (data & 0xC0) != 0x80
        self.tree = Fenwick(_sums(ends), _sums(begins)) if len(data) else Fenwick(np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.closed = int(ends.sum())
        self.points = int(begins.sum())
        self.n = self.closed + int(len(data) > 0 and data[-1] != NEWLINE)

    def end(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) up to the end of the ``unit``-th line."""
        if unit == 0:
            return 0, 0
        if unit > self.closed:  # the last line, which no line feed ends
            return len(self.data), self.points
        block, before, points = self.tree.descend(unit)
        start = block * BLOCK
        own = self.data[start : start + BLOCK]
        size = int(np.flatnonzero(own == NEWLINE)[unit - before - 1]) + 1
        return start + size, points + int(((own[:size] & 0xC0) != 0x80).sum())


def dice(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of 8 digits of SHA-256 over ``seed:id``; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Each whole text with its middle last.

    Returns the id as ``doc_id``, ``n`` (lines), ``form``, ``prefix_chars`` and
    ``middle_chars`` (code points; NULL if plain) and ``output``. Two draws from the id
    choose how many lines the prefix and prefix with middle hold. ``psm`` is prefix,
    suffix, middle, each behind its sign; ``spm`` is suffix, prefix, middle. A text that
    is empty (or null), holds one of the signs or is not among ``rate`` percent stays
    ``plain``, as it was. Rows stay in their tasks: no shuffle. Repeated rows give equal
    rows; a null id draws as an empty one; other columns are left out, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def made(data: np.ndarray, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, bytes]:
        lines, whole = Lines(data), data.tobytes()
        if not whole or any(s in whole for s in signs) or h3 % 100 >= rate:
            return lines.n, "plain", None, None, whole
        low, high = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
        (a, a_points), (b, b_points) = lines.end(low), lines.end(high)
        prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
        if h4 % 100 < spm_rate:
            return lines.n, "spm", a_points, b_points - a_points, b"".join((signs[1], suffix, signs[0], prefix, signs[2], middle))
        return lines.n, "psm", a_points, b_points - a_points, b"".join((signs[0], prefix, signs[1], suffix, signs[2], middle))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, 1, 1024):
                data, offsets = text_bytes(part.column(1))
                draws = [part.column(2 + k).to_pylist() for k in range(4)]
                rows = [made(data[offsets[i] : offsets[i + 1]], *(d[i] for d in draws)) for i in range(len(part))]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                arrays = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = [h.alias(f"h{k}") for k, h in enumerate(dice(F.col(id_col), seed))]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *drawn).mapInArrow(
        batches, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(form: Column, output: Column) -> Column:
    """The text that transform() made ``output`` of: its parts between the signs, put back in order."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
