"""Balanced label propagation into shards, with built-in functions only.

Documents with equal text are linked. Each starts in the shard that its number gives,
so that all shards hold the same count. Then, round by round, linked documents move
towards the shard that holds most of their neighbours, as far as quotas allow, where
rows that leave make room for others. Groups that a shard can hold and that are still
apart then take what room is left, one after another, so at most one is cut at each
border of two shards; documents without links fill the rest, so counts end at most
one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.numbering import BUCKET_ROWS, numbered
from callmetrics.llm.storage import written

SHARDS = 16
ROUNDS = 10
#: Repeats of one row that a task makes at once.
REPEATS = 1 << 16
#: A group larger than a shard's capacity over this moves in cells of about that size.
CELLS = 8


def _admitted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that want from one shard to another may go, for each pair.

    Rows go in cycles, so that each shard gets as many as it gives; a shard with room
    also takes rows without giving any. Shortest cycles (swaps) are taken first for
    each pair; at the end no cycle is left.
    """
    pool = len(room)
    left = dict(wanted) | {(s, pool): n for s, n in enumerate(room) if n > 0} | {(pool, s): sum(wanted.values()) for s in range(pool)}
    gone = dict.fromkeys(wanted, 0)
    for start, end in sorted(wanted):
        while left[start, end]:
            came, queue = {end: end}, [end]
            while queue and start not in came:
                at = queue.pop(0)
                for to in range(pool + 1):
                    if to not in came and left.get((at, to), 0):
                        came[to] = at
                        queue.append(to)
            if start not in came:
                break
            cycle, at = [(start, end)], start
            while at != end:
                cycle.append((came[at], at))
                at = came[at]
            n = min(left[e] for e in cycle)
            for e in cycle:
                left[e] -= n
                if e in gone:
                    gone[e] += n
    return gone


def _round(linked: DataFrame, quota: list[int], cell_rows: int, turn: int) -> tuple[DataFrame, int]:
    """One round: (pos, grp, cell, shard) after the moves that quotas admit, and their count.

    A group wants the shard with most of its rows, ties in an order of its own that
    changes with ``turn``; the cells of a group that no shard can hold want as many of
    its foremost shards as it needs, and one more each round. Rows elsewhere move there.
    What leaves a shard in the same round makes room in it (_admitted). Each pair of
    shards takes its rows by classes of a hash, the last class in part.
    """
    here = linked.groupBy("grp", "shard").agg(F.count("*").alias("votes"))
    # a group has at most one row per shard here, so the list is bounded by the shards
    votes = here.groupBy("grp").agg(F.sum("votes").alias("whole"), F.sort_array(F.collect_list(F.struct("votes", F.xxhash64("grp", "shard", F.lit(turn)).alias("tie"), "shard")), asc=False).alias("ranked"))
    needed = F.ceil(F.col("whole") / quota[-1]) if quota[-1] else F.lit(1)
    needed = F.least(F.when(needed > 1, needed + turn).otherwise(1), F.size("ranked")).cast("int")
    chosen = votes.select("grp", F.ceil(F.col("whole") / cell_rows).alias("cells"), F.slice("ranked.shard", F.lit(1), needed).alias("chosen"))
    to = F.get("chosen", F.floor(F.col("cell") * F.size("chosen") / F.col("cells")).cast("int"))
    wishes = linked.join(chosen, "grp").select("pos", "grp", "cell", "shard", F.when(~F.array_contains("chosen", F.col("shard")), to).alias("to"), F.pmod(F.xxhash64("pos", F.lit(turn)), F.lit(512)).alias("part"))
    wishes = written(wishes, "wishes")
    classes = wishes.filter("to is not null").groupBy("shard", "to", "part").agg(F.count("*").alias("n"))
    wanted = {(r["shard"], r["to"]): r["n"] for r in classes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # one row per pair of shards
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    gone = _admitted(wanted, [q - held.get(s, 0) for s, q in enumerate(quota)])
    count = sum(gone.values())
    if not count:
        return linked, 0
    limits = linked.sparkSession.createDataFrame([(*e, n) for e, n in gone.items() if n], "shard int, to int, limit long")
    upto = F.sum("n").over(Window.partitionBy("shard", "to").orderBy("part"))
    # bounded: pairs of shards x 512 parts
    admitted = classes.join(F.broadcast(limits), ["shard", "to"]).withColumn("takes", F.least(F.col("n"), F.col("limit") - upto + F.col("n"))).filter("takes > 0").select("shard", "to", "part", "takes", (F.col("takes") < F.col("n")).alias("partly"))
    open_ = wishes.join(F.broadcast(admitted), ["shard", "to", "part"], "left").withColumn("partly", F.coalesce("partly", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("shard", "to", "part").orderBy("pos"))
    whole = open_.filter("not partly").select("pos", "grp", "cell", F.when(F.col("takes").isNotNull(), F.col("to")).otherwise(F.col("shard")).alias("shard"))
    partly = open_.filter("partly").withColumn("nth", nth).select("pos", "grp", "cell", F.when(F.col("nth") <= F.col("takes"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
    return written(whole.union(partly), "labels"), count


def _in_a_row(loose: DataFrame, rows: int) -> DataFrame:
    """(pos, turn): the rows numbered from 0 so that those of a group follow each other."""
    buckets = max(1, rows // BUCKET_ROWS + 1)
    groups = loose.groupBy("grp").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    sizes = groups.groupBy("bucket").agg(F.sum("n").alias("rows"))
    starts = sizes.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("from"))  # one row per bucket
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("grp")) - F.col("n")
    starts = groups.withColumn("inside", inside).join(starts, "bucket").select("grp", (F.col("from") + F.col("inside")).alias("from"))
    return numbered(loose, ["grp"], [F.col("pos")], rows, "nth").join(starts, "grp").select("pos", (F.col("from") + F.col("nth")).alias("turn"))


def balanced_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law ``rows``: shard counts are at most one apart. ``size`` is the UTF-8 bytes of the
    text (null: none) plus 1, ``text_crc32`` the CRC-32 of those bytes (null as empty),
    ``slot`` counts the rows of a shard from 0 without gaps, ``grown_shard`` is null, as
    this law has no placing of its own for one more shard. Links are a group's rows to
    its group, never pairs. A group larger than a shard spans several. Equal texts are
    known by 128 bits of xxhash and their length. Null ids, repeated rows (equal texts)
    and empty texts are rows as any; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"))
    base = written(base.groupBy(*base.columns).agg(F.count("*").alias("repeats")), "documents")
    total = base.agg(F.coalesce(F.sum("repeats"), F.lit(0))).first()[0]
    order = [F.col("doc_id"), F.col("g1"), F.col("g2")]
    firsts = written(numbered(base, [], order, total, "first", "repeats").withColumn("last", F.col("first") + F.col("repeats") - 1), "firsts")
    once = firsts.filter(F.col("repeats") <= REPEATS)
    # a row that is there more often is dealt to tasks in runs
    runs = firsts.filter(F.col("repeats") > REPEATS).withColumn("run", F.explode(F.sequence("first", "last", F.lit(REPEATS).cast("long")))).repartition("run")
    runs = runs.withColumn("last", F.least("last", F.col("run") + REPEATS - 1)).withColumn("first", F.col("run")).drop("run")
    pos = F.explode(F.sequence("first", "last")).alias("pos")
    docs = written(once.union(runs).select("doc_id", "size", "text_crc32", "g1", "g2", pos), "numbered")
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    cell_rows = max(1, quota[-1] // CELLS)
    sizes = docs.groupBy("g1", "g2", "size").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select("g1", "g2", "size", F.xxhash64("g1", "g2", "size").alias("grp"), F.ceil(F.col("n") / cell_rows).cast("int").alias("cells"))
    grouped = docs.select("pos", "g1", "g2", "size").join(sizes, ["g1", "g2", "size"], "left").select("pos", "grp", "cells")
    linked = written(grouped.filter("grp is not null").select("pos", "grp", F.pmod(F.xxhash64("pos"), F.col("cells")).cast("int").alias("cell"), F.pmod("pos", F.lit(shards)).cast("int").alias("shard")), "labels")
    for turn in range(rounds):
        linked, moves = _round(linked, quota, cell_rows, turn)
        if not moves:
            break
    spans = linked.groupBy("grp", "shard").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("spans"))
    split = spans.filter((F.col("n") <= quota[-1]) & (F.col("spans") > 1)).select("grp")
    loose = written(linked.join(split, "grp", "left_semi").select("pos", "grp"), "loose")
    linked = written(linked.join(split, "grp", "left_anti").select("pos", "shard"), "labels")
    held = dict.fromkeys(range(shards), 0) | {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    single = written(grouped.filter("grp is null").select("pos"), "single")
    filling = _in_a_row(loose, total).union(numbered(single, [], [F.col("pos")], total, "turn").select("pos", F.col("turn") + loose.count()))
    shard, upto = F.lit(None), total - sum(held.values())
    for s in reversed(range(shards)):  # turns 0, 1, ... fill the room of shard 0, then of 1, ...
        shard = F.when(F.col("turn") < upto, s).otherwise(shard)
        upto -= quota[s] - held[s]
    placed = linked.select("pos", "shard").union(filling.select("pos", shard.cast("int").alias("shard")))
    placed = written(docs.join(placed, "pos").select("doc_id", "size", "text_crc32", "shard", "pos"), "placed")
    slots = numbered(placed, ["shard"], [F.col("pos")], total // shards + 1, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
