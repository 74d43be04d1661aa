"""N-grams inside sentences, their filters, collocations and the bigram network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import in_list


def ngrams(sentences: DataFrame, n: int, toks: str = "toks") -> DataFrame:
    """(gram, count) over arrays of tokens; sentences shorter than n give none."""
    t = F.col(toks)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.slice(t, i, n))
    return sentences.filter(F.size(t) >= n).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("count"))


def clean_edges(counts: DataFrame, stop: frozenset[str]) -> DataFrame:
    """Grams of words only, whose first and last are no stop words."""
    words = F.forall("gram", lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return counts.filter(words & ~in_list(F.element_at("gram", 1), stop) & ~in_list(F.element_at("gram", -1), stop))


def summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("unique"), F.count_if(F.col("count") == 1).alias("singletons")).withColumn("singleton_share", F.when(F.col("unique") > 0, F.round(F.col("singletons") / F.col("unique"), 4)).otherwise(0.0))


def top(counts: DataFrame, k: int = 10) -> DataFrame:
    """The commonest; ties by the gram itself."""
    return counts.select(F.array_join("gram", " ").alias("ngram"), "count").orderBy(F.desc("count"), "ngram").limit(k)


def invented(after: DataFrame, before: DataFrame) -> DataFrame:
    """Grams after stop-word removal that never occur before it."""
    return after.join(before, "gram", "left_anti")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def collocations(sentences: DataFrame, stop: frozenset[str], n: int = 2, min_freq: int = 3, toks: str = "toks") -> DataFrame:
    """(ngram, count, log_likelihood, pmi): G2 of independence over the full table, and pointwise mutual information.

    The size N counts the words and one end mark for each sentence; grams never cross the mark.
    For trigrams the expectation is that of three independent words.
    """
    marked = sentences.select(F.concat(F.col(toks), F.array(F.lit("</s>"))).alias("toks"))
    unit = marked.select(F.explode("toks").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    total = unit.agg(F.sum("c").cast("double").alias("_total"))
    grams = clean_edges(ngrams(sentences, n, toks), stop).filter(F.col("count") >= min_freq).withColumnRenamed("count", "n")
    for i in range(n):
        grams = grams.withColumn(f"w{i}", F.element_at("gram", i + 1)).join(unit.select(F.col("w").alias(f"w{i}"), F.col("c").cast("double").alias(f"c{i}")), f"w{i}")
    grams = grams.join(F.broadcast(total))  # one row
    N, k = F.col("_total"), F.col("n").cast("double")
    expected = F.col("c0")
    for i in range(1, n):
        expected = expected * F.col(f"c{i}") / N
    pmi = F.log2(k / expected)
    if n == 2:
        a, b, c = k, F.col("c0") - k, F.col("c1") - k
        d = N - F.col("c0") - F.col("c1") + k
        rows = _xlogx(F.col("c0")) + _xlogx(N - F.col("c0")) + _xlogx(F.col("c1")) + _xlogx(N - F.col("c1"))
        g2 = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) - rows + _xlogx(N))
    else:
        pairs = ngrams(marked, 2).select(F.element_at("gram", 1).alias("x"), F.element_at("gram", 2).alias("y"), F.col("count").cast("double").alias("p"))
        skip = marked.filter(F.size("toks") >= 3).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("toks") - 2), lambda i: F.array(F.element_at("toks", i), F.element_at("toks", i + 2)))).alias("g")).groupBy("g").agg(F.count("*").cast("double").alias("p"))
        grams = grams.join(pairs.select(F.col("x").alias("w0"), F.col("y").alias("w1"), F.col("p").alias("p01")), ["w0", "w1"], "left")
        grams = grams.join(pairs.select(F.col("x").alias("w1"), F.col("y").alias("w2"), F.col("p").alias("p12")), ["w1", "w2"], "left")
        grams = grams.join(skip.select(F.col("g")[0].alias("w0"), F.col("g")[1].alias("w2"), F.col("p").alias("p02")), ["w0", "w2"], "left")
        z = lambda c: F.coalesce(c, F.lit(0.0))
        p01, p12, p02 = z(F.col("p01")), z(F.col("p12")), z(F.col("p02"))
        c0, c1, c2 = F.col("c0"), F.col("c1"), F.col("c2")
        cells = {
            (1, 1, 1): k, (1, 1, 0): p01 - k, (1, 0, 1): p02 - k, (0, 1, 1): p12 - k,
            (1, 0, 0): c0 - p01 - p02 + k, (0, 1, 0): c1 - p01 - p12 + k, (0, 0, 1): c2 - p02 - p12 + k,
            (0, 0, 0): N - c0 - c1 - c2 + p01 + p02 + p12 - k,
        }
        g2 = F.lit(0.0)
        for (x, y, w), o in cells.items():
            e = (c0 if x else N - c0) * (c1 if y else N - c1) / N * (c2 if w else N - c2) / N
            g2 = g2 + F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0)
    return grams.select(F.array_join("gram", " ").alias("ngram"), F.col("n").alias("count"), F.round(g2, 2).alias("log_likelihood"), F.round(pmi, 3).alias("pmi"))


def network(bigrams: DataFrame, top_edges: int = 60) -> tuple[DataFrame, DataFrame]:
    """(id, weight) nodes and (source, target, weight) edges of the commonest bigrams; a loop counts twice for its node."""
    edges = bigrams.select(F.element_at("gram", 1).alias("source"), F.element_at("gram", 2).alias("target"), F.col("count").alias("weight")).orderBy(F.desc("weight"), "source", "target").limit(top_edges)
    ends = edges.select(F.col("source").alias("id"), "weight").union(edges.select("target", "weight"))
    return ends.groupBy("id").agg(F.sum("weight").alias("weight")), edges


def variants(sentences: DataFrame, stop: frozenset[str], sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(n, variant, gram, count): all grams of words, those with clean edges, and those after stop words are removed.

    All are counted in one aggregate. Clean edges are tested on the counted grams, and single words
    after removal are those with clean edges.
    """
    words = sentences.select(F.filter("toks", lambda w: w.rlike(r"[\p{L}\p{N}]")).alias("words"))
    both = words.withColumn("kept", F.filter("words", lambda w: ~in_list(w, stop)))

    def cut(c: str, n: int, after: bool) -> Column:
        t = F.col(c)
        none = F.array().cast("array<string>")
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.coalesce(t, none) if n == 1 else F.transform(places, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.struct(F.lit(n).alias("n"), F.lit(after).alias("after"), grams.alias("grams"))

    kinds = [cut(c, n, c == "kept") for n in sizes for c in ("words", "kept") if n > 1 or c == "words"]
    each = both.select(F.explode(F.array(*kinds)).alias("x")).select("x.n", "x.after", F.explode("x.grams").alias("ngram"))
    counts = each.groupBy("n", "after", "ngram").agg(F.count("*").alias("count"))
    clean = ~in_list(F.substring_index("ngram", " ", 1), stop) & ~in_list(F.substring_index("ngram", " ", -1), stop)
    name = lambda test, v: F.when(test, F.lit(v))
    of = F.array(name(~F.col("after"), "all"), name(~F.col("after") & clean, "meaningful_filter"), name(F.col("after") | ((F.col("n") == 1) & clean), "after_stopword_removal"))
    return counts.select("n", F.explode(F.filter(of, lambda v: v.isNotNull())).alias("variant"), "ngram", "count")


def variant_tops(found: DataFrame, k: int = 10) -> DataFrame:
    """(n, variant, rank, ngram, count, frequency, total, unique): the k commonest of each size and variant."""
    sums = found.groupBy("n", "variant").agg(F.sum("count").alias("total"), F.count("*").alias("unique"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("n", "variant").orderBy(F.desc("count"), "ngram"))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(sums), ["n", "variant"]).select("n", "variant", "rank", "ngram", "count", F.round(F.col("count") / F.col("total"), 6).alias("frequency"), "total", "unique")
