"""Which conversations share which openings: a trie of turns over all conversations.

Turns become hashes at once; texts cross no shuffle. A conversation's turns are numbered
by ranges of their order and cut into segments, so even one endless conversation is many
rows. Equal segments after equal beginnings are counted once. They are then ordered by
their turns and dealt out by ranges; each stretch of that order is a shard: its turns get
dense ids, a double array is packed over them, and all segments walk through it together.
Nodes that several shards share (beginnings that many conversations have) are merged by
their key, and what that changes in their subtrees is carried up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.mixing import word_count
from callmetrics.llm.storage import written

#: Rebuilding: every conversation takes its opening from the first of this many ids, at most OPENING - 1 turns.
FAMILY, OPENING = 20, 4
#: Turns of a segment, turns that a shard's double array holds about, and bits of an id that a run of ids leaves out.
SEGMENT, SHARD_TURNS, RUN_BITS = 1024, 1 << 17, 12
#: Turns at a segment's start that place it among the ranges; longer ties go by the whole segment's key.
RANGE_TURNS = 4
#: Free cells that a node with several children tries before it goes to the end of the arrays.
TRIES = 64


class DoubleArray:
    """A trie in two arrays: the child of cell s by id c is cell BASE[s] + c if CHECK there is s."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.used, self.free = bytearray(1024), 1
        self.used[0] = 1  # the root
        self.top = 1

    def _room(self, cells: int) -> None:
        if cells > len(self.used):
            size = max(cells, 2 * len(self.used))
            self.base = np.concatenate((self.base, np.zeros(size - len(self.base), np.int64)))
            self.check = np.concatenate((self.check, np.full(size - len(self.check), -1, np.int64)))
            self.used.extend(bytes(size - len(self.used)))

    def _fits(self, ids: list[int]) -> int:
        """A base under which the cells of all ``ids`` (rising) are free."""
        used, cell = self.used, self.used.find(0, self.free)
        for _ in range(TRIES):
            if cell < 0 or cell >= self.top:
                break
            base = cell - ids[0]
            if all(base + c >= len(used) or not used[base + c] for c in ids[1:]):
                return base
            cell = used.find(0, cell + 1)
        return self.top - ids[0]

    def add(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children of one level: pairs in order of (parent, id), each once. Large families first."""
        first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        count = np.diff(np.concatenate((first, [len(parents)])))
        for family in np.argsort(-count, kind="stable"):
            a, parent = int(first[family]), int(parents[first[family]])
            own = ids[a : a + int(count[family])].tolist()
            base = self._fits(own)
            self._room(base + own[-1] + 1)
            self.base[parent] = base
            for c in own:
                self.used[base + c] = 1
                self.check[base + c] = parent
            self.top = max(self.top, base + own[-1] + 1)
            free = self.used.find(0, self.free)
            self.free = self.top if free < 0 else min(free, self.top)

    def step(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of ``cells`` by ``ids``, -1 where there is none."""
        to = self.base[cells] + ids
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == cells), to, -1)


NODE = (
    "k1 long, k2 long, p1 long, p2 long, depth long, first long, parent_first long, n long, words long, opens boolean, "
    "spent long, once long, leaves long, children long, leaf boolean, inner boolean, goes_on boolean"
)


def digests(column: pa.Array) -> np.ndarray:
    """A column of 16-byte digests as rows of two numbers."""
    if not len(column):
        return np.zeros((0, 2), np.uint64)
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[offset : offset + 16 * len(column)].view(np.uint64).reshape(-1, 2)


def dense_ids(turns: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The number of each turn: turns are numbered as they first occur, level by level, so
    that the children of a node have neighbouring numbers where they can."""
    known, which = np.unique(turns, axis=0, return_inverse=True)
    which, order = which.reshape(-1), np.argsort(level, kind="stable")
    seen = np.empty(len(turns), np.int64)
    seen[order] = np.arange(len(turns))
    earliest = np.full(len(known), len(turns), np.int64)
    np.minimum.at(earliest, which, seen)
    number = np.empty(len(known), np.int64)
    number[np.argsort(earliest)] = np.arange(len(known))
    return number[which]


def shard_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The nodes of the segments of one shard, with what their subtrees hold in it.

    The walk is level by level: the pairs of (cell, turn) of all segments that reach the
    level are packed, then every segment steps to its next cell. Sums go up the same levels.
    """
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    whole = lambda name: col[name].to_numpy(zero_copy_only=False)
    starts = np.stack((whole("s1"), whole("s2")), 1)
    count, first, going, opened = whole("n"), whole("first"), whole("going"), whole("from_depth")
    turns = col["turns"]
    size = np.asarray(turns.value_lengths().fill_null(0)).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    flat = turns.flatten()
    step1, step2, words = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("h1", "h2", "words"))
    dense = dense_ids(digests(flat.field("t")), np.arange(begin[-1]) - np.repeat(begin[:-1], size))
    # where a segment begins is a first step like any other: from the root by the number of its start
    at = np.unique(starts, axis=0, return_inverse=True)[1].reshape(-1)
    arrays = DoubleArray()
    levels: list[dict[str, np.ndarray]] = []
    cells, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    live = np.arange(len(size))
    depth = -1  # before the start's own step
    while len(live):
        ids = at[live] if depth < 0 else dense[begin[live] + depth]
        pairs = np.unique(np.stack((cells[live], ids), 1), axis=0)
        arrays.add(pairs[:, 0], pairs[:, 1])
        cells[live] = arrays.step(cells[live], ids)
        own, lead, member = np.unique(cells[live], return_index=True, return_inverse=True)
        sample = live[lead]
        level = {"n": np.zeros(len(own), np.int64), "first": np.full(len(own), np.iinfo(np.int64).max), "going": np.zeros(len(own), np.int64), "up": place[sample].copy()}
        np.add.at(level["n"], member, count[live])
        np.minimum.at(level["first"], member, first[live])
        np.add.at(level["going"], member, going[live])
        if depth < 0:
            level |= {"k1": starts[sample, 0], "k2": starts[sample, 1], "depth": opened[sample], "words": np.zeros(len(own), np.int64)}
        else:
            spot, up = begin[sample] + depth, levels[-1]
            level |= {"k1": up["k1"][level["up"]] ^ step1[spot], "k2": up["k2"][level["up"]] ^ step2[spot], "depth": up["depth"][level["up"]] + 1, "words": words[spot].astype(np.int64)}
        levels.append(level)
        place[live] = member
        depth += 1
        live = live[size[live] > depth]

    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        below = levels[i + 1] if i + 1 < len(levels) else None
        level["children"] = np.bincount(below["up"], minlength=len(level["n"])) if below else np.zeros(len(level["n"]), np.int64)
        level["leaf"] = (level["children"] == 0) & (level["going"] == 0)
        level["spent"], level["once"], level["leaves"] = level["n"] * level["words"], level["words"].copy(), level["leaf"].astype(np.int64)
        if below:
            for name in ("spent", "once", "leaves"):
                np.add.at(level[name], below["up"], below[name])
    out: dict[str, list[np.ndarray]] = {name.split()[0]: [] for name in NODE.split(", ")}
    hidden: list[np.ndarray] = []
    for i, level in enumerate(levels):
        up = levels[i - 1] if i else None
        opens = np.full(len(level["n"]), i == 0) & (level["depth"] > 0)
        level |= {"opens": opens, "inner": level["children"] > 0, "goes_on": level["going"] > 0}
        level |= {"p1": up["k1"][level["up"]] if up else level["k1"], "p2": up["k2"][level["up"]] if up else level["k2"], "parent_first": up["first"][level["up"]] if up else level["first"]}
        # a start beyond the root is a node of the segment before, which counts its members and words
        level["n"] = np.where(opens, 0, level["n"])
        for name in out:
            out[name].append(level[name])
        hidden.append(np.full(len(level["n"]), i == 0))
    no_parent = np.concatenate(hidden)
    kinds = {"opens": pa.bool_(), "leaf": pa.bool_(), "inner": pa.bool_(), "goes_on": pa.bool_()}
    made = {name: np.concatenate(parts) for name, parts in out.items()}
    columns = [pa.array(made[name], kinds.get(name, pa.int64()), mask=no_parent if name in ("p1", "p2", "parent_first") else None) for name in made]
    return pa.RecordBatch.from_arrays(columns, list(made))


def shards(batch: pa.RecordBatch, turns: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of about so many turns; one segment is never cut."""
    upto = np.cumsum(np.asarray(batch.column(batch.schema.get_field_index("turns")).value_lengths().fill_null(0)) + 1)
    low = 0
    while low < len(batch):
        before = int(upto[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(upto, before + turns, "right")))
        yield batch.slice(low, high - low)
        low = high


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t, words): each turn as a hash, its place in its conversation from 1.

    By turn, null first; turns that tie go by role, then by the hash. The rows are sorted
    in ranges, so a conversation may span many tasks; within each range its rows are
    numbered, and sums of the ranges before tell where each begins.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("t"), word_count(text).alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t")]
    ranged = written(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("conv_id", "part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__rank", F.row_number().over(inside)).join(begin, ["conv_id", "part"])
    return numbered.select("conv_id", (F.col("__before") + F.col("__rank")).alias("at"), "t", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, at, t, words) and all conversations (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % FAMILY (all it
    has if fewer, none if it is absent); its own follow from its (h + 1)-th on. h is its
    id's unsigned CRC-32 modulo OPENING, so an opening is at most OPENING - 1 turns.
    """
    mine = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    mine = mine.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    opening = turns.filter((F.col("at") < OPENING) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "t", "words"))).alias("opening"))
    mine = mine.join(opening, "base", "left").withColumn("opening", F.when(F.col("opening").isNotNull(), F.slice("opening", F.lit(1), F.col("h"))).otherwise(F.array().cast("array<struct<at:bigint,t:binary,words:bigint>>")))
    mine = written(mine.select("conv_id", "h", "opening", F.size("opening").alias("taken"), (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.size("opening")).alias("length")), "conversations")
    heads = mine.select("conv_id", F.inline("opening"))
    rest = turns.join(mine.select("conv_id", "h", "taken"), "conv_id").filter(F.col("at") > F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "t", "words")
    return heads.unionByName(rest), mine.select("conv_id", "length")


def segments(turns: DataFrame, conversations: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct segments, and where each conversation ends.

    Segments: where they start (s1, s2: key of the node before; from_depth), where they end
    (e1, e2), their ``turns``, how many conversations have them (``n``), the first of
    these (``first``) and how many go on behind them (``going``). Ends: (conv_id, e1, e2).
    The key of a node is the exclusive or of two hashes of (place, turn) over its turns,
    so where a segment starts follows from whole segments before it, in any order.
    """
    of = turns.withColumn("h1", F.xxhash64("at", "t")).withColumn("h2", F.xxhash64(F.lit(7), "t", "at")).withColumn("part", F.expr(f"(at - 1) div {size}"))
    turn = F.struct("at", "t", "h1", "h2", "words")
    cut = of.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.sort_array(F.collect_list(turn)).alias("turns"))  # at most ``size`` turns
    zero = F.lit(0).cast("long")
    none = conversations.filter("length = 0").select("conv_id", zero.alias("part"), zero.alias("d1"), zero.alias("d2"), F.array().cast(cut.schema["turns"].dataType).alias("turns"))
    cut = written(cut.unionByName(none), "segments")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    for k in (1, 2):
        light = cut.select("conv_id", "part", "d1", "d2") if k == 1 else light
        light = light.withColumn(f"s{k}", F.coalesce(F.bit_xor(f"d{k}").over(earlier), zero)).withColumn(f"e{k}", F.col(f"s{k}").bitwiseXOR(F.col(f"d{k}")))
    light = light.join(conversations, "conv_id").withColumn("goes_on", F.col("length") > (F.col("part") + 1) * size)
    light = written(light.select("conv_id", "part", "s1", "s2", "e1", "e2", "goes_on"), "spots")
    distinct = cut.select("conv_id", "part", "turns").join(light, ["conv_id", "part"]).groupBy("s1", "s2", (F.col("part") * size).alias("from_depth"), "e1", "e2").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.count_if("goes_on").alias("going"), F.first("turns").alias("turns")
    )
    return distinct, light.filter("not goes_on").select("conv_id", "e1", "e2")


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ids that end at each node, rising, joined by commas.

    Ids of one run (all but RUN_BITS of their bits equal) are sorted and joined first, many
    runs at once; a node's runs then go through one hash in order, which holds nothing else.
    """
    runs = ends.groupBy(F.col("e1").alias("k1"), F.col("e2").alias("k2"), F.shiftright("conv_id", RUN_BITS).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")  # ids are distinct: at most 2 ** RUN_BITS
    )

    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in stream:
            done = []
            for k1, k2, ids in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield ended(done)
        if node is not None:
            yield ended([(*node, state.hexdigest())])

    def ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["k1", "k2", "ends_sha256"])

    return runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "run").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


SUMS = ("spent", "once", "leaves")


def carried_up(upper: DataFrame) -> DataFrame:
    """(k1, k2, spent, once, leaves): sums over each node's subtree within ``upper``, which
    holds k1, k2, p1, p2 (parent, NULL at the root), depth and the values to sum, and with
    any node all above it. Each round adds what lies as many levels below as all rounds
    before reached together, so long paths take few rounds."""
    now = written(upper, "upper")
    rounds = (now.agg(F.max("depth")).first()[0] or 0).bit_length()
    for _ in range(rounds):
        below = now.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*(F.sum(v).alias(f"more_{v}") for v in SUMS))
        above = now.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("g1"), F.col("p2").alias("g2"))
        both = now.join(above, ["p1", "p2"], "left").join(below, ["k1", "k2"], "left")
        now = written(both.select("k1", "k2", F.col("g1").alias("p1"), F.col("g2").alias("p2"), *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in SUMS)), "upper")
    return now.select("k1", "k2", *SUMS)


def prefix_nodes(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations (see rebuilt()).

    ``conversations`` holds conv_id, turn, role and text; other columns are left out,
    whatever their names. Null role or text is as empty; rows without a conv_id belong to
    no conversation; repeated rows are turns of their own. Returns conv_id (the smallest
    member), depth, parent_conv_id (NULL at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. No conversations give no rows, not even a root.
    """
    turns, lengths = rebuilt(written(ordered_turns(conversations), "numbered"))
    distinct, ends = segments(turns, lengths, segment)
    opening = F.transform(F.slice("turns", 1, RANGE_TURNS), lambda x: x["t"])
    ordered = distinct.repartitionByRange("s1", "s2", opening, "e1").sortWithinPartitions("s1", "s2", F.transform("turns", lambda x: x["t"]))

    def nodes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in shards(batch, shard_turns):
                yield shard_nodes(part)

    found = ordered.mapInArrow(nodes, NODE)
    own = F.when(~F.col("opens"), F.lit(1)).otherwise(F.lit(0))
    merged = found.groupBy("k1", "k2").agg(
        F.max("depth").alias("depth"), F.min("first").alias("conv_id"), F.min("parent_first").alias("parent_first"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n").alias("n_convs"),
        F.max("words").alias("words"), F.sum(own).alias("copies"), F.sum("children").alias("n_children"), F.bool_or("goes_on").alias("goes_on"), F.bool_or("leaf").alias("leaf"), F.bool_or("inner").alias("inner"),
        *(F.sum(F.when(~F.col("opens"), F.col(v)).otherwise(0)).alias(v) for v in SUMS), *(F.sum(F.when(F.col("opens"), F.col(v)).otherwise(0)).alias(f"next_{v}") for v in SUMS),
    )
    merged = written(merged, "nodes")
    # nodes that more than one shard has, and those above a further segment: with any node, all above it
    shared = merged.filter("copies > 1 or goes_on or depth = 0")
    twice = F.when(F.col("leaf") & F.col("inner"), F.lit(1)).otherwise(F.lit(0))
    change = {"spent": F.col("next_spent"), "once": F.col("next_once") - (F.col("copies") - 1) * F.col("words"), "leaves": F.col("next_leaves") - twice}
    carried = carried_up(shared.select("k1", "k2", "p1", "p2", "depth", *(c.cast("long").alias(v) for v, c in change.items())))
    above = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("shared_parent"))
    placed = merged.join(above, ["p1", "p2"], "left")
    children = placed.filter("shared_parent is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("all_children"))
    extra = carried.select("k1", "k2", *(F.col(v).alias(f"more_{v}") for v in SUMS)).join(children, ["k1", "k2"], "left").withColumn("known", F.lit(True))
    out = placed.join(extra, ["k1", "k2"], "left").join(end_digests(ends), ["k1", "k2"], "left")
    total = lambda v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0))
    return out.select(
        "conv_id", "depth", F.coalesce("shared_parent", "parent_first").alias("parent_conv_id"), "n_convs", F.when(F.col("known"), F.coalesce("all_children", F.lit(0).cast("long"))).otherwise(F.col("n_children")).alias("n_children"),
        total("leaves").alias("n_leaves"), (total("spent") - total("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
