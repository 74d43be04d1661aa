"""Token counts through a digest cache.

Each document's normalised content and the tokenizer's version give a digest. Digests are
joined to a stored table of counts; only one representative of each digest that is missing is
encoded, and its count is appended to the store. A second run over the same corpus encodes
nothing.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import unit_bpe
from .common import scratch, written

_STORE = "digest binary, version string, n_tokens long"
#: Texts of these characters only have the same tokens in lower case with single spaces.
_PLAIN = r"[^\x09\x0A\x0D\x20-\x7E¡-įı-ɏ]|<\|"


def tokenizer_version(path: str) -> str:
    """sha256 of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32] + "/" + tokenizers.__version__


def normalised(text: Column) -> Column:
    """Lower case and single spaces where the tokenizer can't tell the difference, else the text itself."""
    plain = F.lower(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(text.rlike(_PLAIN), text).otherwise(plain)


def _encode(path: str):
    def run(batches):
        c = unit_bpe.counter(path)
        unit_bpe.forget(c)
        for b in (part for x in batches for part in unit_bpe.slices(x, "text")):
            n = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("version"), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, store: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``store`` is the folder of the cache (one Parquet part for each run); without one the run
    starts with an empty cache in the shared folder. A null text counts as empty: 0 bytes, 0
    tokens. Rows with the same or a null doc_id each give a row of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    store = store or scratch(spark, "token-counts")
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = written(
        raw.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("raw"), F.unhex(F.sha2(F.concat(F.lit(version + "\n"), normalised(F.col("text"))), 256)).alias("digest")),
        "digests",
    )
    first = keyed.groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("first"))
    try:
        known = spark.read.schema(_STORE).parquet(f"{store}/*").filter(F.col("version") == version)
        first = first.join(known, "digest", "left_anti")
    except AnalysisException:  # no store yet
        pass
    first = first.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.raw").alias("first_raw"))
    texts = (
        raw.withColumn("raw", F.xxhash64("text"))
        .join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("raw") == F.col("first_raw")))
        .select("digest", F.lit(version).alias("version"), "text")
    )
    part = f"{store}/run-{uuid.uuid4().hex}"
    texts.mapInArrow(_encode(tokenizer_path), _STORE).write.parquet(part)
    counts = spark.read.schema(_STORE).parquet(f"{store}/*").filter(F.col("version") == version).select("digest", "n_tokens")
    # Repeated rows in the input or runs side by side may store a digest twice; one of each is joined.
    if counts.groupBy("digest").count().filter("count > 1").limit(1).count():
        counts = written(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts-once")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
