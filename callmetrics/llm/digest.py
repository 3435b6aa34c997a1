"""Canonical exact digests, with built-in column functions only.

A text is put in Unicode's composed form, case is folded and white space collapsed;
the canonical bytes are grouped by a 128-bit xxhash, and equal hashes count as equal
texts only after their bytes compare equal.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.llm.storage import written

SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Conjoining Hangul: a leading consonant and a vowel, or a whole syllable, and a final consonant.
HANGUL = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"
CLUSTER = r"(?s)[^\p{M}]?\p{M}+"


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str, str]:
    """From this Python's Unicode data, as texts for _lookup() and a character class:
    full decompositions, compositions of two characters, combining classes, and the
    characters that never occur in composed text though they stand alone."""
    full: dict[str, str] = {}
    pairs: dict[str, str] = {}
    classes: dict[str, str] = {}
    alone = []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if k := unicodedata.combining(c):
            classes[c] = str(k)
        if 0xAC00 <= code <= 0xD7A3:
            continue
        whole = unicodedata.normalize("NFD", c)
        if whole != c:
            full[c] = whole
            if unicodedata.normalize("NFC", c) == c:
                pairs["".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split())] = c
            elif not unicodedata.category(c).startswith("M"):
                alone.append(code)
    full_text, pairs_text, classes_text = ("\x01" + "".join(f"{k}\x02{v}\x01" for k, v in t.items()) for t in (full, pairs, classes))
    known = set(alone)
    starts, ends = [c for c in alone if c - 1 not in known], [c for c in alone if c + 1 not in known]
    return full_text, pairs_text, classes_text, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _lookup(table: str, key: Column) -> Column:
    """The value of ``key`` in a text of entries (U+0001, key, U+0002, value), or null."""
    probe = F.concat(F.lit("\x01"), key, F.lit("\x02"))
    onward = F.call_function("substring_index", F.lit(table), probe, F.lit(-1))
    return F.when(F.contains(F.lit(table), probe), F.call_function("substring_index", onward, F.lit("\x01"), F.lit(1)))


def _code(code: Column) -> Column:
    """The character with a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _compose_cluster(cluster: Column) -> Column:
    """One base character (or none) and its marks, decomposed, ordered and composed again."""
    full, pairs, classes, _ = _tables()
    one_by_one = F.regexp_extract_all(cluster, F.lit("(?s)."), F.lit(0))
    apart = F.array_join(F.transform(one_by_one, lambda c: F.coalesce(_lookup(full, c), c)), "")
    chars = F.transform(F.regexp_extract_all(apart, F.lit("(?s)."), F.lit(0)), lambda c: F.struct(F.coalesce(_lookup(classes, c).cast("int"), F.lit(0)).alias("k"), c.alias("c")))
    # marks sort by class, stably, between characters of class 0
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<struct<run:int,k:int,n:int,c:string>>)").alias("out"), F.lit(0).alias("run"))

    def place(acc: Column, x: Column) -> Column:
        run = acc["run"] + F.when(x["k"] == 0, 1).otherwise(0)
        return F.struct((acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(F.struct(run.alias("run"), x["k"].alias("k"), acc["n"].alias("n"), x["c"].alias("c")))).alias("out"), run.alias("run"))

    ordered = F.array_sort(F.aggregate(chars, start, place, lambda acc: acc["out"]))
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def join(acc: Column, x: Column) -> Column:
        both = _lookup(pairs, F.concat(acc["base"], x["c"]))
        free = (acc["base"] != "") & F.when(acc["marks"] == "", F.lit(True)).otherwise((acc["last"] < x["k"]) & (x["k"] != 0))
        joined = F.struct(acc["done"].alias("done"), both.alias("base"), acc["marks"].alias("marks"), acc["last"].alias("last"))
        fresh = F.struct(F.concat(acc["done"], acc["base"], acc["marks"]).alias("done"), x["c"].alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
        added = F.struct(acc["done"].alias("done"), acc["base"].alias("base"), F.concat(acc["marks"], x["c"]).alias("marks"), x["k"].alias("last"))
        return F.when(free & both.isNotNull(), joined).when(x["k"] == 0, fresh).otherwise(added)

    return F.aggregate(ordered, empty, join, lambda acc: F.concat(acc["done"], acc["base"], acc["marks"]))


def _compose_hangul(part: Column) -> Column:
    first, second = F.ascii(part), F.ascii(F.substring(part, 2, 1))
    third = F.when(F.length(part) == 3, F.ascii(F.substring(part, 3, 1)) - 0x11A7).otherwise(0)
    whole = F.when(first < 0x1200, 0xAC00 + ((first - 0x1100) * 21 + second - 0x1161) * 28 + third)
    already = F.when(F.pmod(first - 0xAC00, F.lit(28)) == 0, _code(first + second - 0x11A7)).otherwise(part)
    return F.when(first < 0x1200, _code(whole)).otherwise(already)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _replace_each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Every distinct match of ``pattern``, longest first, replaced by what ``change`` makes of it."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    longest = F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.aggregate(longest, text, lambda acc, x: F.replace(acc, x["x"], change(x["x"])))


def composed(text: Column) -> Column:
    """Unicode's canonical composed form (NFC), by the Unicode data of this Python.

    Only texts with marks, conjoining Hangul or characters that composition removes are
    worked on; all others are in that form already.
    """
    full, _, _, alone = _tables()

    def compose(t: Column) -> Column:
        single = _replace_each(t, alone, lambda x: _lookup(full, x))
        marked = _once(single, lambda s: _replace_each(s, CLUSTER, _compose_cluster))
        return _once(marked, lambda m: _replace_each(m, HANGUL, _compose_hangul))

    # all characters up to U+02FF are in composed form: most texts end at this first test
    other = rf"\p{{M}}|{HANGUL}|{alone}"
    return _once(text, lambda t: F.when(t.rlike(r"[^\x{0}-\x{2FF}]") & t.rlike(other), compose(t)).otherwise(t))


def canonical(text: Column) -> Column:
    """Composed, case-folded (upper, then lower; sharp s as ss, final sigma as sigma), composed again;
    runs of white space become one space, none at either end. Null stays null."""
    folded = F.translate(F.lower(F.upper(F.replace(composed(text), F.lit("ß"), F.lit("ss")))), "ς", "σ")
    return F.trim(F.regexp_replace(composed(folded), SPACES, " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash as 32 hex digits: two runs with different seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), text)), 16, "0")))


def collisions(hashed: DataFrame) -> DataFrame | None:
    """(hash, canon, place) for different canonical texts of one hash, places 2, 3, ... by
    text; None if there are none.

    ``hashed`` is a written table of (text, hash). Hashes of one row need no comparison;
    texts of the others are made canonical again and grouped by hash and bytes. That
    combines before it shuffles, so a text with a third of all rows is one row of each task.
    """
    repeated = written(hashed.groupBy("hash").agg(F.count("*").alias("rows")).filter("rows > 1").select("hash"), "repeated")
    # hashes that repeat grow with the corpus, so they are never broadcast
    canon = hashed.select("hash", "text").join(repeated.hint("merge"), "hash", "left_semi").select("hash", canonical(F.col("text")).alias("canon"))
    texts = written(canon.groupBy("hash", "canon").agg(F.count("*").alias("rows")).withColumn("texts", F.count("*").over(Window.partitionBy("hash"))).filter("texts > 1").select("hash", "canon"), "collisions")
    if texts.isEmpty():
        return None
    order = Window.partitionBy("hash").orderBy("canon")
    return written(texts.withColumn("place", F.row_number().over(order)).filter("place > 1"), "collisions")


def with_places(df: DataFrame, text_col: str, hash_col: str, places: DataFrame | None) -> DataFrame:
    """Makes the hashes of ``hash_col`` fingerprints: followed by the place of the text if
    different texts share a hash (``places`` from collisions()). Equal texts get equal
    fingerprints and different texts different ones."""
    if places is None:
        return df
    named = places.select(F.col("hash").alias(hash_col), F.col("canon").alias("__canon"), F.col("place").alias("__place"))
    joined = df.withColumn("__canon", canonical(F.col(text_col))).join(named, [hash_col, "__canon"], "left")
    return joined.withColumn(hash_col, F.concat_ws("-", F.col(hash_col), F.col("__place").cast("string"))).drop("__canon", "__place")


def exact_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row's whole text.

    Null text counts as empty; n_chars are code points. Repeated rows each give a row,
    equal texts share their fingerprint whatever their ids; an empty table gives no
    rows; other columns are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    hashed = written(docs.withColumn("hash", wide_hash(canonical(F.col("text")))), "hashed")
    rows = with_places(hashed, "text", "hash", collisions(hashed))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.col("hash").alias("fingerprint"))


#: monotonically_increasing_id() numbers the rows of a partition in its lower 33 bits.
PART_BITS = 33


def numbered_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text, hash, part, n) by descending doc_id (null ids last, ties by the first 64
    characters of the text, then a hash of it): ranges of about equal numbers of rows,
    whatever the ids, are ``part`` and ``n`` numbers the rows of each from 0. Written, so
    that numbers stay as they are.

    Rows that repeat both id and text are told apart by their place in the input, so
    that they too fill several ranges; ``docs`` should come from files.
    """
    placed = docs.withColumn("start", F.substring("text", 1, 64)).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("start"), F.col("tie"), F.col("place")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 26)
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = dealt.select("doc_id", "text", F.monotonically_increasing_id().alias("id")).withColumn("hash", wide_hash(canonical(F.col("text"))))
    part = F.shiftright("id", PART_BITS)
    return written(rows.select("doc_id", "text", "hash", part.alias("part"), (F.col("id") - F.shiftleft(part, PART_BITS)).alias("n")), "numbered")


def followed(rows: DataFrame) -> DataFrame:
    """Adds ``next_text`` and ``next_hash`` to the rows of numbered_by_id(): those of the row
    after it, and for the last row those of the first.

    Each range is one window; its last row takes the first row of the next range, of
    which there is one for each range.
    """
    inside = Window.partitionBy("part").orderBy("n")
    heads = rows.filter("n = 0").select("part", F.struct("text", "hash").alias("head"))
    # one row per range, without its text
    along = Window.orderBy("part")
    first = F.first("part").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    onward = rows.filter("n = 0").select("part").select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(along), first).alias("part"))
    heads = written(heads.join(onward, "part").select(F.col("before").alias("part"), "head"), "heads")
    # a struct of both would cross the shuffle beside them, with every text a second time
    led = rows.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_hash", F.lead("hash").over(inside))
    follow = led.join(heads, "part", "left")
    return follow.select("doc_id", "text", "hash", F.coalesce("next_text", "head.text").alias("next_text"), F.coalesce("next_hash", "head.hash").alias("next_hash"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``other``, or all."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def edited_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see ``edited``), whose
    other half is the next document's by descending id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. An exact digest knows equal or not: likeness is 1.0 when
    the canonical bytes are equal, else 0.0. Null text counts as empty; an empty table
    gives no rows; a sole document is its own next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = numbered_by_id(df.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    places = collisions(docs)
    rows = followed(docs).withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_hash", wide_hash(canonical(F.col("edited"))))

    def likeness(other: str) -> Column:  # bytes are compared where hashes are equal
        same = F.transform(F.array("text", other), canonical)
        return F.when(F.col("hash") != F.col("edited_hash" if other == "edited" else "next_hash"), 0.0).when(_once(same, lambda t: t[0] == t[1]), 1.0).otherwise(0.0)

    rows = rows.withColumn("near_edited", likeness("edited")).withColumn("near_next", likeness("next_text"))
    rows = with_places(with_places(rows, "text", "hash", places), "edited", "edited_hash", places)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"), "near_edited", "near_next"
    )
