"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius.

Distinct fingerprints are dealt to shards that agree in two of ``radius + 2`` bit
blocks: ``radius`` differing bits leave at least two blocks untouched, so every close
pair meets in some shard. In a shard the fingerprints form a BK-tree: children are
keyed by their Hamming distance to the parent, and a search follows only the edges
within the radius. All trees of a task are built and searched together, level by
level, as numpy arrays. A shard gives the edges of a spanning forest, never all its
pairs, and the edges of all shards are joined into components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.storage import written
from callmetrics.llm.words import slices, text_bytes

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: A shard with more fingerprints is dealt to several tasks, each with two of its parts.
SHARD_ROWS = 4096
#: Rows whose trees are built together, and (query, node) pairs searched together.
FOREST_ROWS = 1 << 17
FRONTIER = 1 << 18


def text_fingerprints(texts: list[bytes], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints of UTF-8 texts; 0 for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z, and the six ASCII spaces
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= n:
            out[i] = digest(joined, SEED)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - n] + 1).tolist()]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)
        ones = np.zeros(64, np.int64)
        for low in range(0, len(hashes), 1 << 14):
            part = hashes[low : low + (1 << 14)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text; null text counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, 1, 512):
                data, offsets = text_bytes(part.column(1))
                whole = data.tobytes()
                texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_fingerprints(texts, n).view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, fp long")


class Forest:
    """BK-trees over rows sorted by shard; rows that are not in a tree only ask."""

    def __init__(self, shard: np.ndarray, value: np.ndarray, in_tree: np.ndarray) -> None:
        self.value = value
        tree = np.flatnonzero(in_tree)
        first = np.r_[True, shard[tree][1:] != shard[tree][:-1]] if len(tree) else np.zeros(0, bool)
        roots = tree[first]
        self.root_of = np.full(len(shard), -1, np.int64)
        if len(roots):
            at = np.searchsorted(shard[roots], shard)
            at[at == len(roots)] = 0
            known = shard[roots][at] == shard
            self.root_of[known] = roots[at[known]]
        keys, children = [], []
        waiting = tree[~first]
        node = self.root_of[waiting]
        while len(waiting):
            key = node * 65 + np.bitwise_count(value[waiting] ^ value[node])
            found, at, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(waiting[at])
            rest = np.ones(len(waiting), bool)
            rest[at] = False
            node, waiting = waiting[at][which][rest], waiting[rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def near(self, asking: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asking row, tree row) within the radius, some at a time."""
        asking = asking[self.root_of[asking] >= 0]
        stack = [(asking[low : low + 4096], self.root_of[asking[low : low + 4096]]) for low in range(0, len(asking), 4096)]
        while stack:
            rows, nodes = stack.pop()
            if len(rows) > FRONTIER:
                stack += [(rows[low : low + FRONTIER], nodes[low : low + FRONTIER]) for low in range(0, len(rows), FRONTIER)]
                continue
            distance = np.bitwise_count(self.value[rows] ^ self.value[nodes]).astype(np.int64)
            close = (distance <= radius) & (rows != nodes)
            if close.any():
                yield rows[close], nodes[close]
            low = np.searchsorted(self.keys, nodes * 65 + np.maximum(distance - radius, 0))
            count = np.searchsorted(self.keys, nodes * 65 + np.minimum(distance + radius, 64), "right") - low
            total = int(count.sum())
            if total:
                inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                stack.append((np.repeat(rows, count), self.children[np.repeat(low, count) + inside]))


def spanning_links(shard: np.ndarray, value: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints of a shard that connect all it links within ``radius``.

    Rows are sorted by shard. Role 1 is in the tree, 2 asks, 3 does both.
    """
    change = np.flatnonzero(shard[1:] != shard[:-1]) + 1
    size = np.diff(np.r_[0, change, len(shard)])
    several = np.repeat(size > 1, size)
    shard, value, role = shard[several], value[several], role[several]
    forest = Forest(shard, value, (role & 1) > 0)
    part = np.arange(len(shard))
    above = part.tolist()

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    left, right = [], []
    for a, b in forest.near(np.flatnonzero(role & 2), radius):
        apart = np.flatnonzero(part[a] != part[b])
        if not len(apart):
            continue
        _, at = np.unique(part[a[apart]] * len(part) + part[b[apart]], return_index=True)
        for i in apart[at].tolist():
            x, y = top(int(a[i])), top(int(b[i]))
            if x != y:
                above[x] = y
                left.append(a[i])
                right.append(b[i])
        part = np.asarray(above)
        while (part != part[part]).any():
            part = part[part]
    return value[np.array(left, np.int64)], value[np.array(right, np.int64)]


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect every pair within ``radius`` bits.

    Shards above SHARD_ROWS are cut into parts by a hash; each pair of parts makes a
    task of its own (one part's tree, the other part asking), so no tree outgrows its
    task and no pair is missed.
    """
    blocks = radius + 2
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    masks = [((1 << w) - 1) << sum(width[:i]) for i, w in enumerate(width)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in (a | b for a, b in combinations(masks, 2))]
    keyed = values.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))).alias("key"))
    large = written(keyed.groupBy("key").count().filter(F.col("count") > SHARD_ROWS), "large-shards")
    parts = F.coalesce(F.ceil(F.col("count") / SHARD_ROWS), F.lit(1)).cast("int")
    dealt = keyed.join(large, "key", "left").select("key", "fp", parts.alias("parts"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    role = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    shard = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(shard.alias("shard"), "fp", role.alias("role")).repartition("shard").sortWithinPartitions("shard")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: np.ndarray, value: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
            a, b = spanning_links(shard, value.view(np.uint64), role, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[list[np.ndarray]] = []
        count = 0
        for batch in stream:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += len(batch)
            if count >= FOREST_ROWS:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shard may go on
                if whole:
                    yield found(*(c[:whole] for c in columns))
                held, count = [[c[whole:] for c in columns]], count - whole
        if count:
            yield found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return dealt.mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge list (a, b) reaches.

    Large-star and small-star steps in turn, each an aggregation and a join written to
    the shared folder, until the edges stay as they are. Hubs are split by the skew
    handling of the joins.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.*").filter("a <> b").distinct(), "small-star")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    A-Z are lower-cased; words are cut at ASCII white space; shingles are ``n`` words
    joined by a space (all words if there are fewer), repeats included. A bit is 1 if it
    is set in more than half the shingle hashes. Texts without words, null ones too,
    have fingerprint 0, which links like any other. ``component_id`` is the smallest
    doc_id that links reach; a null doc_id is in its component but names none, and a
    component of only such rows has null. Repeated rows each give a row; an empty table
    gives none; other columns are left out, whatever their names.
    """
    docs = written(fingerprints(df, id_col, text_col, n), "fingerprints")
    values = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    found = components(links(values.select("fp"), radius))
    roots = values.join(found, values["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``df`` (with doc_id and text) without near-duplicates: the row of each component
    with the smallest doc_id stays, nulls last, ties by a hash of the text; of repeated
    rows one."""
    # the id and a hash of the text as one key that is never null: join and dedup share a partitioning
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")
    marked = df.withColumn("__key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text_hash))
    identity = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")
    docs = written(fingerprints(marked.withColumn("__identity", identity), "__identity", "text", n), "fingerprints")
    values = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    found = components(links(values.select("fp"), radius))
    roots = values.join(found, values["fp"] == found["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    kept = roots.groupBy("root").agg(F.min("least")["__key"].alias("__key"))
    return marked.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*df.columns)
