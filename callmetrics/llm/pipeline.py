"""The stages that make a training corpus of ``documents``.

Each takes (spark, docs, sf_dir). All but the last return the columns of docs, whatever
other columns there are and however they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm import bpe, langid, mixing, simhash, toxicity
from callmetrics.llm.queries import toxicity_chain, vocabulary_path
from callmetrics.llm.storage import read_table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; rejected ones go."""
    return langid.accepted_only(docs, langid.fit(read_table(spark, sf_dir, "documents")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not find toxic."""
    return toxicity.without(docs, toxicity_chain(spark, sf_dir), "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once, or repeated. The document
    travels as one value, so that no column of it meets one of the mix."""
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.systematic_copies(sized).filter("copies > 0")
    return mixed.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).select("__doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy in the mix, and digests of them decoded again."""
    return bpe.encode_decode(docs, vocabulary_path(), digests=True)
