"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integer impacts. A term is a dimension; a block is a range of
documents with the least and greatest impact of each term, and a forward index (its
ids and impact matrix). For a query the sum over terms of the greatest product that a
block allows bounds all scores in it. Blocks are visited in falling order of that
bound, each scored through its forward index, until the bound falls below the k-th
score so far. What is skipped cannot enter the result, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.storage import written

BLOCK_ROWS = 256
#: Blocks that one task holds at once, and queries that it answers over them.
GROUP_BLOCKS = 48
QUERY_ROWS = 4096
#: Products are summed in float64 as long as no sum can leave its whole numbers.
EXACT = 2.0**53


def impacts(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id long, impacts array<long>): floor(scale * component) of usable vectors.

    Null vectors and those with a null or non-finite component take no part, nor do
    rows without an id.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)
    return rows.select("vec_id", F.transform("vector", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("impacts"))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pack_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The block index: one row per block of at most ``block_rows`` vectors.

    Vectors are first ordered by their strongest term, which keeps the maxima of a
    block tight, and then by id; equal strongest terms are salted over 16 tasks.
    """
    strongest = F.array_position(F.transform("impacts", F.abs), F.array_max(F.transform("impacts", F.abs)))
    dealt = rows.withColumn("term", F.coalesce(strongest, F.lit(0))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    dealt = dealt.repartition("term", "salt").sortWithinPartitions("term", "vec_id").select("vec_id", "impacts")

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for low in range(0, len(batch), block_rows):
                part = batch.slice(low, block_rows)
                vectors = [np.asarray(v, np.int64) for v in part.column(1).to_pylist()]
                width = max(map(len, vectors))
                matrix = _matrix(vectors, width)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[0])]), pa.array([width], pa.int32()), pa.array([ids.tobytes()]), pa.array([matrix.tobytes()]), pa.array([matrix.min(0).tobytes()]), pa.array([matrix.max(0).tobytes()])],
                    ["first_id", "width", "ids", "matrix", "least", "most"],
                )

    return dealt.mapInArrow(pack, "first_id long, width int, ids binary, matrix binary, least binary, most binary")


class _Index:
    """Blocks of one task."""

    def __init__(self, blocks: pd.DataFrame) -> None:
        self.width = int(blocks["width"].max())
        self.ids = [np.frombuffer(b, np.int64) for b in blocks["ids"]]
        self.matrices = [self._wide(b, w) for b, w in zip(blocks["matrix"], blocks["width"], strict=True)]
        self.least = np.vstack([self._wide(b, w) for b, w in zip(blocks["least"], blocks["width"], strict=True)])
        self.most = np.vstack([self._wide(b, w) for b, w in zip(blocks["most"], blocks["width"], strict=True)])
        self.largest = float(max(np.abs(self.least).max(initial=0), np.abs(self.most).max(initial=0)))
        self.floats: list[np.ndarray | None] = [None] * len(self.ids)

    def _wide(self, data: bytes, width: int) -> np.ndarray:
        flat = np.frombuffer(data, np.int64).reshape(-1, width)
        return np.pad(flat, ((0, 0), (0, self.width - width)))

    def scores(self, block: int, query: np.ndarray, exact: bool) -> np.ndarray:
        if not exact:
            return self.matrices[block] @ query
        if self.floats[block] is None:
            self.floats[block] = self.matrices[block].astype(np.float64)
        return (self.floats[block] @ query.astype(np.float64)).astype(np.int64)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.zeros(self.width, np.int64)
        q[: min(self.width, len(query))] = query[: self.width]
        exact = float(np.abs(q).sum()) * max(1.0, self.largest) < EXACT
        up, down = (np.maximum(q, 0), np.minimum(q, 0)) if exact else (np.maximum(q, 0).astype(object), np.minimum(q, 0).astype(object))
        bounds = self.most @ up + self.least @ down
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in np.argsort(-bounds, kind="stable"):
            if len(ids) >= k and bounds[block] < scores[-1]:
                break
            s = self.scores(block, q, exact)
            take = self.ids[block] != own
            if len(ids) >= k:
                take &= s >= scores[-1]
            if take.any():
                ids, scores = np.concatenate([ids, self.ids[block][take]]), np.concatenate([scores, s[take]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        return ids, scores


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best candidates of each query by integer inner product.

    Both sides hold (vec_id, impacts) as ``impacts()`` gives them. A candidate with the
    query's own id is no match; ties go to the smaller id; fewer than k candidates are
    all returned; no candidate or no query gives no rows. Shorter vectors count as
    padded with zeros. Repeated query rows are asked once; repeated candidate rows each
    match. Returns query_id, rank (from 1), vec_id, score.

    Groups of blocks meet tiles of queries in a grouped join: every task holds
    GROUP_BLOCKS blocks and at most QUERY_ROWS queries, and passes on k rows a query.
    """
    index = written(pack_blocks(candidates), "blocks")
    total = index.count()
    groups = max(1, -(-total // GROUP_BLOCKS))
    asked = queries.dropDuplicates(["vec_id", "impacts"])
    tiles = max(1, -(-asked.count() // QUERY_ROWS))
    left = index.withColumn("grp", F.pmod(F.xxhash64("first_id", "ids"), F.lit(groups))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = asked.withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(tiles)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(blocks) and len(asked):
            held = _Index(blocks)
            for own, query in zip(asked["vec_id"], asked["impacts"], strict=True):
                ids, scores = held.search(own, np.asarray(query, np.int64), k)
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    part = left.groupBy("grp", "tile").cogroup(right.groupBy("grp", "tile")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
