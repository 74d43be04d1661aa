"""The corpus pipeline: documents to token shards, every stage a table in the shared folder.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, what is left is put in the order of the sources' target weights, and its token
ids are written to shards in that order.

Every stage keeps columns that it does not know, under any name, and all rows that it has no
reason to drop; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, mixing, simhash, token_shards, toxicity
from loomtext.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic, by a network trained on the labelled ones.

    Null and empty texts have the score of no words; rows with equal texts are judged alike.
    Without labels of both kinds nothing is learnt and nothing goes.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of the smallest doc_id.

    Rows without doc_id stay, and so do rows that share an id but not their text; rows repeated
    whole leave one. Null and blank texts are near-duplicates of each other.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark.

    Null and empty texts hold none. Items under eight words are no evidence and match nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the schedule.

    A null source is a source of its own, a null doc_id counts as 0; rows with equal ids are
    ordered by a hash of the row, rows repeated whole are all kept.
    """
    return mixing.mixed(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from shards in the order in which ``docs`` was written.

    Null and empty texts have the end id alone; every row has an entry, whatever its id.
    """
    return token_shards.read_shards(token_shards.write_shards(token_shards.in_written_order(docs), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]

#: A trained network and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
