"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import langid, licenses, mixing, toxicity
from .ann import nearest
from .common import table
from .decontaminate import contaminated_documents
from .repeats import without_repeats
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_shards import read_shards, write_shards

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_token_counts(spark, sf_dir):
    """Tokens of every whole text under the word vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op2_token_shards(spark, sf_dir):
    """Ids of every whole text, written to sorted shards in doc_id order and read back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), "doc_id", "text")
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json")))


@_query
def op3_decontamination(spark, sf_dir):
    """Documents that hold passages of the benchmark."""
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op4_mixing(spark, sf_dir):
    """The scheduled place of every document."""
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("tie")


ORACLES["op4_mixing"] = mixing.ORACLE


@_query
def op7_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op6_toxicity(spark, sf_dir):
    """Toxicity of every whole text."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query
def op10_langid(spark, sf_dir):
    """Language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@_query
def op5_nearest(spark, sf_dir):
    """The 20 largest inner products of every 20th vector."""
    return nearest(table(spark, sf_dir, "embeddings"))


@_query
def op8_repeats(spark, sf_dir):
    """What remains of every document without its repeated strings of 400 bytes, and its words in passages that other documents share."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")  # a string may end inside a character


@_query
def op9_licenses(spark, sf_dir):
    """Licence paragraphs of every document."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))
