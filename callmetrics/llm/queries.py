"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import bpe, digest, fim, langid, licenses, maxent, mixing, prefixtrie, sharding, simhash, tokencount, topk, toxicity
from callmetrics.llm.storage import read_table, written

#: Name of the vocabulary file in the folder of public tokenizers, which every node has.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.systematic_copies(written(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.impacts(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.filter("vec_id % 100 = 0"))


#: Categories in the order of the chain, from the labels table.
def toxicity_categories() -> dict:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    return toxicity.fit_chain(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), toxicity_categories())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir))


def crc32_of_id() -> F.Column:
    """CRC-32 of doc_id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    models = langid.fit(docs, crc32_of_id() % 5 != 0)
    return langid.identify(docs, models).select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = maxent.train_and_score(docs, crc32_of_id() % 7 != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_digests(read_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(read_table(spark, sf_dir, "documents"))
    digest_of = lambda text, name: F.sha2(text.cast("binary"), 256).alias(name)
    back = fim.restored(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest_of(F.col("output"), "output_sha256"), digest_of(back, "restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_nodes(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_topk, op3_toxicity, op4_language, op5_maxent, op6_licenses, op7_fingerprints, op8_bpe, op9_sharding, op10_simhash,
        op11_fim, op12_token_counts, op13_prefix_trie,
    )
}

_OP1 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), ordered as (
  select *, lpad(length(bin(size))::varchar, 2, '0') || substr(bin(size), 1, 4) as class, md5('mix:' || coalesce(doc_id::varchar, '')) as h from sized
), named as (
  select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as turn from sized group by source
), weighed as (
  select source, source_size, case turn % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight, 3 * source_size as most from named
), shared as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))::bigint::double
    / (sum(weight) over (order by most / weight, encode(source) nulls last rows between current row and unbounded following))::bigint as share from weighed
), level as (
  select arg_min(share, most / weight) filter (where share * weight < most) as level from shared
), targets as (
  select source, source_size, case when level is null or level * weight >= most then most::double else level * weight end as target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5))::bigint as start
  from shared, level
), ranked as (
  select o.doc_id, o.size, t.source_size, t.target, t.start,
    case when t.source_size > 0 then floor(t.target / t.source_size * 1048576 + 0.5)::bigint else 0 end as expected,
    row_number() over (partition by o.source order by o.class || substr(o.h, 1, 2), o.h, o.size) as n
  from ordered o join targets t on o.source is not distinct from t.source
)
select doc_id, size, source_size, target, (((start + n * expected) // 1048576 - (start + (n - 1) * expected) // 1048576) * size)::bigint as taken from ranked
"""

_OP2 = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from rows q join rows c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

_OP11 = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents
), cut as (
  select *, len(u) as n, (('0x' || substr(h, 1, 8))::bigint) % (len(u) + 1) as a, (('0x' || substr(h, 9, 8))::bigint) % (len(u) + 1) as b, (('0x' || substr(h, 25, 8))::bigint) % 100 < 50 as spm,
    text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') as plain from drawn
), parts as (
  select doc_id, text, n, spm, plain, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m, array_to_string(u[greatest(a, b) + 1:], '') as s from cut
)
select doc_id, n::bigint as n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form, case when not plain then length(p) end::bigint as prefix_chars, case when not plain then length(m) end::bigint as middle_chars,
  sha256(case when plain then text when spm then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from parts
"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint), lambda z, y: list_reduce(range(0, 8), lambda v, i: xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end), xor(z, y)), 4294967295::bigint))"

_OP13 = rf"""
with own as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null
), convs as (
  select c, max(pos) as own, c - c % 20 as base, {_CRC} % 4 as h from own group by c
), opening as (
  select convs.c, o.pos, o.r, o.x from convs join own o on o.c = convs.base and o.pos <= h
), taken as (
  select convs.*, coalesce(k, 0) as k from convs left join (select c, count(*) as k from opening group by c) o using (c)
), turns as (
  select * from opening union all select own.c, pos - h + k, r, x from own join taken using (c) where pos > h
), paths as (
  select c, pos as depth, list(md5(length(r) || ':' || r || x)) over (partition by c order by pos rows unbounded preceding) as path, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as words from turns
  union all select c, 0, [], 0 from convs
), keyed as (
  select c, depth, md5(array_to_string(path, '')) as k, md5(array_to_string(path[1:depth - 1], '')) as up, words, max(depth) over (partition by c) as length from paths
), nodes as (
  select depth, k, any_value(case when depth > 0 then up end) as up, min(c) as conv_id, count(*) as n_convs, any_value(words) as words, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (length = depth), '')) as ends_sha256 from keyed group by depth, k
), families as (
  select up, depth - 1 as depth, count(*) as n_children from nodes where up is not null group by up, depth
), grown as (
  select nodes.*, coalesce(n_children, 0) as n_children from nodes left join families f on f.up = nodes.k and f.depth = nodes.depth
), below as (
  select a.depth, a.k, count(*) filter (g.n_children = 0) as n_leaves, sum((g.n_convs - 1) * g.words) as saved_tokens from grown g join keyed a on a.c = g.conv_id and a.depth <= g.depth group by a.depth, a.k
)
select g.conv_id, g.depth::bigint as depth, p.conv_id as parent_conv_id, g.n_convs, g.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, g.ends_sha256
from grown g join below b on b.k = g.k and b.depth = g.depth left join grown p on p.k = g.up and p.depth = g.depth - 1
"""

#: DuckDB SQL for the rows of the queries that SQL can express.
ORACLES: dict[str, str] = {"op1_mixing": _OP1, "op2_topk": _OP2, "op11_fim": _OP11, "op13_prefix_trie": _OP13}
