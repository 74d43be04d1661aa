"""Results to files: CSV tables, JSON blobs, the index in Parquet or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import PositionalIndex
from ..operators.pipeline import Pipeline


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_index(index: PositionalIndex, path: str) -> None:
    """Postings sorted by term in range files, so that a look-up reads few row groups; and the documents."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def load_index(spark: SparkSession, path: str, pipeline: Pipeline) -> PositionalIndex:
    return PositionalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), pipeline)


def stored_index(index: PositionalIndex, path: str) -> PositionalIndex:
    """The index written and read again: searches then read its tables, not the texts."""
    save_index(index, path)
    return load_index(index.docs.sparkSession, path, index.pipeline)


def index_json(index: PositionalIndex, positions: bool = True) -> DataFrame:
    """(term, block, json): df, cf and a block of the postings of each term, with positions or the documents only."""
    posts = F.col("postings") if positions else F.transform("postings", lambda p: p["doc_id"])
    return index.grouped().select("term", "block", F.to_json(F.struct("df", "cf", posts.alias("postings"))).alias("json"))


def index_from_json(exported: DataFrame, docs: DataFrame, pipeline: Pipeline, doc_id: str = "long") -> PositionalIndex:
    """The index of (term, json) with positions and of the table of all documents; surfaces are the terms themselves."""
    posts = F.from_json("json", f"postings array<struct<doc_id: {doc_id}, positions: array<int>>>")["postings"]
    each = exported.select("term", F.explode(posts).alias("p"))
    return PositionalIndex(each.select("term", "p.doc_id", F.explode("p.positions").alias("pos"), F.col("term").alias("surface")), docs.select("doc_id").distinct(), pipeline)
