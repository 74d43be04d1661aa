"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids to (v, root): the smallest id that each linked id can reach.

    Alternating large-star and small-star steps; rounds grow with the logarithm of the number
    of ids. Minima are taken by partial aggregates and joined as written tables, so that
    adaptive execution can split the links of one hot id; nothing is gathered in one place.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        star = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        star = written(star, "links")
        discard(e, low)
        e = star
        low = written(e.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        e = written(e, "links")
        discard(star, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    roots = written(roots.union(e.select("v", F.col("v").alias("root"))).distinct(), "roots")
    discard(e)
    return roots
