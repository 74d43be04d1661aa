"""What the operators share: the cluster's shared folder, written tables and label samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where a local session names none, as in tests, a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, so that the shared folder doesn't fill up."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(c: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def id_crc(c: str = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


def bounded_sample(df: DataFrame, by: str, per_class: int, *key: str) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by a hash of the key (doc_id if none is given).

    The counts are exact and over all rows; the share kept of a class is per_class / count, so
    the sample's size is bounded by the number of classes, whatever the size of the input.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    span = 1 << 30
    share = F.lit(0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(by) == F.lit(value), F.lit(min(span, span * per_class // n))).otherwise(share)
    return df.filter(F.pmod(F.xxhash64(*(key or ("doc_id",)), F.lit("sample")), F.lit(span)) < share)
