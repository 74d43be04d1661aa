"""The positional inverted index as tables: postings, document lengths and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pipeline import Pipeline, postings, tokens


@dataclass
class PositionalIndex:
    """postings(term, doc_id, pos, surface) and docs(doc_id): all documents, those without terms too."""

    postings: DataFrame
    docs: DataFrame
    pipeline: Pipeline

    @classmethod
    def build(cls, docs: DataFrame, p: Pipeline) -> "PositionalIndex":
        return cls(postings(tokens(docs, p), p), docs.select("doc_id").distinct(), p)

    def cache(self) -> "PositionalIndex":
        self.postings, self.docs = self.postings.persist(), self.docs.persist()
        return self

    # ---- statistics
    def tf(self) -> DataFrame:
        """(term, doc_id, tf)"""
        return self.postings.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))

    def terms(self) -> DataFrame:
        """(term, df, cf): two partial aggregates instead of a distinct count."""
        return self.tf().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def size(self) -> DataFrame:
        """One row: n, all documents."""
        return self.docs.agg(F.count("*").alias("n"))

    def idf(self) -> DataFrame:
        return self.terms().join(F.broadcast(self.size())).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))

    def tfidf(self) -> DataFrame:
        """(term, doc_id, tf, tfidf)"""
        return self.tf().join(self.idf(), "term").select("term", "doc_id", "tf", ((1 + F.log10("tf")) * F.col("idf")).alias("tfidf"))

    def doc_len(self) -> DataFrame:
        n = self.postings.groupBy("doc_id").agg(F.count("*").alias("doc_len"))
        return self.docs.join(n, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))

    def grouped(self, block_docs: int = 1 << 16) -> DataFrame:
        """(term, block, df, cf, postings): positions of each document, ascending; the form for export.

        A term's postings go in blocks of documents (by ranges of numeric ids, else by a hash),
        so that no row holds those of the whole corpus; df and cf are those of the block.
        """
        numeric = dict(self.postings.dtypes)["doc_id"] in ("int", "bigint")
        block = F.expr(f"doc_id div {block_docs}") if numeric else F.pmod(F.xxhash64("doc_id"), F.lit(1024))
        each = self.postings.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        return each.groupBy("term", block.cast("long").alias("block")).agg(F.count("*").alias("df"), F.sum(F.size("positions")).cast("long").alias("cf"), F.sort_array(F.collect_list(F.struct("doc_id", "positions"))).alias("postings"))

    # ---- look-ups
    def term(self, term: str, positions: int = 50, surfaces: int = 15) -> tuple[DataFrame, DataFrame]:
        """Postings by falling tf with the first positions; the commonest surface forms."""
        own = self.postings.filter(F.col("term") == term)
        docs = own.groupBy("doc_id").agg(F.count("*").alias("tf"), F.slice(F.sort_array(F.collect_list("pos")), 1, positions).alias("positions")).orderBy(F.desc("tf"), "doc_id")
        return docs, own.groupBy("surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface").limit(surfaces)

    def df_histogram(self) -> DataFrame:
        return self.terms().groupBy("df").agg(F.count("*").alias("terms"))

    def heatmap(self, top: int = 30) -> DataFrame:
        """(term, doc_id, tf) of the terms with the largest cf for every document, zero where absent."""
        best = self.terms().orderBy(F.desc("cf"), "term").limit(top).select("term")
        grid = self.docs.crossJoin(F.broadcast(best))  # a bounded list of terms for each document
        return grid.join(self.tf().join(F.broadcast(best), "term", "left_semi"), ["term", "doc_id"], "left").select("term", "doc_id", F.coalesce("tf", F.lit(0)).alias("tf"))

    def phrase_docs(self, terms: list[tuple[str, int]]) -> DataFrame:
        """(doc_id, matches) of the documents that hold the terms at the same relative offsets."""
        return phrase_starts(self.postings, terms).groupBy("doc_id").agg(F.count("*").alias("matches"))


def idf(n: Column, df: Column) -> Column:
    return F.log10(n / df)


def unit_starts(posts: DataFrame, units: list[list[tuple[str, int]]]) -> DataFrame:
    """(doc_id, u, start): where each unit's terms stand at their relative offsets; one scan and one aggregate for all units.

    A term's places in the units are looked up; each match sets the bit of its place, and a
    unit is there where all its bits meet at one start. Units of more than 62 terms count places.
    """
    places: dict[str, list[tuple[int, int, int]]] = {}
    sizes = []
    for u, terms in enumerate(units):
        offsets = sorted({off - terms[0][1] for _, off in terms})
        sizes.append(len(offsets))
        for t, off in dict.fromkeys(terms):
            places.setdefault(t, []).append((u, off - terms[0][1], offsets.index(off - terms[0][1])))
    where = F.array().cast("array<struct<u: int, off: int, bit: int>>")
    for t, at in places.items():
        where = F.when(F.col("term") == t, F.array(*[F.struct(F.lit(u).alias("u"), F.lit(off).alias("off"), F.lit(bit).alias("bit")) for u, off, bit in at])).otherwise(where)
    hits = posts.filter(F.col("term").isin(list(places))).select("doc_id", "pos", F.explode(where).alias("x")).select("doc_id", "x.u", (F.col("pos") - F.col("x.off")).alias("start"), "x.bit")
    group = hits.groupBy("doc_id", "u", "start")
    need = F.coalesce(*[F.when(F.col("u") == u, F.lit(n)) for u, n in enumerate(sizes)])
    if max(sizes) <= 62:
        return group.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).filter(F.bit_count("bits") == need).select("doc_id", "u", "start")
    return group.agg(F.countDistinct("bit").alias("k")).filter(F.col("k") == need).select("doc_id", "u", "start")


def phrase_starts(posts: DataFrame, terms: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start) of the matches of one phrase."""
    return unit_starts(posts, [terms]).select("doc_id", "start")


def fidelity(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(key, truth, found, jaccard, preserved) for two tables (key, doc_id) of documents by key."""
    both = truth.select("key", "doc_id", F.lit(1).alias("t")).distinct().join(found.select("key", "doc_id", F.lit(1).alias("f")).distinct(), ["key", "doc_id"], "full_outer")
    g = both.groupBy("key").agg(F.count("t").alias("truth"), F.count("f").alias("found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("inter"), F.count("*").alias("all"))
    return g.select("key", "truth", "found", F.round(F.col("inter") / F.col("all"), 4).alias("jaccard"), (F.col("inter") == F.col("all")).alias("preserved"))


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
