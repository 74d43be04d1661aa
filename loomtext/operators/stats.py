"""Corpus statistics: documents, Zipf and Heaps curves, histograms, tokenizer audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doc_stats(docs: DataFrame, toks: DataFrame) -> DataFrame:
    """doc_id, sentences, tokens, word_tokens, characters, vocabulary, type_token_ratio, hapax."""
    words = toks.groupBy("doc_id", F.when(F.col("is_word"), F.lower("surface")).alias("w")).agg(F.count("*").alias("c"), F.max("sent_no").alias("last"))
    per = words.groupBy("doc_id").agg(
        (F.max("last") + 1).alias("sentences"), F.sum("c").alias("tokens"), F.sum(F.when(F.col("w").isNotNull(), F.col("c"))).alias("word_tokens"),
        F.count("w").alias("vocabulary"), F.count_if(F.col("w").isNotNull() & (F.col("c") == 1)).alias("hapax"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    all_docs = docs.select("doc_id", F.length("text").cast("long").alias("characters")).join(per, "doc_id", "left")
    return all_docs.select("doc_id", z("sentences").alias("sentences"), z("tokens").alias("tokens"), z("word_tokens").alias("word_tokens"), z("characters").alias("characters"), z("vocabulary").alias("vocabulary"), F.round(z("vocabulary") / F.greatest(F.lit(1), z("word_tokens")), 4).alias("type_token_ratio"), z("hapax").alias("hapax"))


def corpus_summary(stats: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("sentences", "tokens", "word_tokens", "characters")]
    return stats.agg(F.count("*").alias("documents"), *sums, F.round(F.sum("tokens") / F.greatest(F.lit(1), F.count("*")), 1).alias("avg_tokens"), F.round(F.sum("characters") / F.greatest(F.lit(1), F.count("*")), 1).alias("avg_characters"))


def with_totals(df: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Rows by ``by`` with TOTAL and AVERAGE rows below: one rollup."""
    r = df.rollup(by).agg(F.grouping(by).alias("g"), F.count("*").alias("n"), *[F.sum(m).cast("double").alias(m) for m in measures])
    total = r.filter("g = 1")
    label = lambda s: F.lit(s).alias("label")
    out = r.filter("g = 0").select(F.col(by).cast("string").alias("label"), *measures)
    out = out.union(total.select(label("TOTAL"), *measures))
    return out.union(total.select(label("AVERAGE"), *[F.round(F.col(m) / F.col("n"), 1).alias(m) for m in measures]))


def ranked(counts: DataFrame) -> DataFrame:
    """Adds the rank of (term, count) by falling count, then term.

    Types of one count and beginning are ranked apart, and the sizes of the groups before are
    added: only the small table of groups is ordered as a whole.
    """
    c = counts.withColumn("_h", F.substring("term", 1, 4))
    sizes = c.groupBy("count", "_h").agg(F.count("*").alias("_n"))
    before = sizes.select("count", "_h", (F.sum("_n").over(Window.orderBy(F.desc("count"), "_h")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("count", "_h").orderBy("term"))
    return c.withColumn("_i", inside).join(before, ["count", "_h"]).select("term", "count", (F.col("_before") + F.col("_i")).alias("rank"))


def zipf(counts: DataFrame) -> DataFrame:
    """(types, slope) of the least-squares line of log frequency over log rank; counts has one row for each type."""
    return ranked(counts).agg(F.count("*").alias("types"), F.round(F.regr_slope(F.log10("count"), F.log10("rank")), 3).alias("slope"))


def zipf_points(counts: DataFrame, n: int = 400) -> DataFrame:
    """(rank, term, count) at about n ranks spread evenly on the log scale."""
    size = counts.agg(F.count("*").alias("types"))
    marks = size.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.greatest(F.lit(1), F.round(F.pow(F.lit(10.0), k * F.log10("types") / n)).cast("int"))))).alias("rank"))
    return ranked(counts).join(F.broadcast(marks), "rank").select("rank", "term", "count")  # at most n + 1 marks


def heaps_points(toks: DataFrame, steps: int = 60) -> DataFrame:
    """(tokens, vocabulary) after each of ``steps`` even marks of the running text (documents by id).

    Global token numbers come from per-document totals, summed by runs of neighbouring ids and
    then inside them, and a type counts from its first occurrence: nothing runs over the tokens
    in one task.
    """
    words = toks.select("doc_id", "pos", F.lower("surface").alias("w"))
    inside = words.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    numeric = dict(words.dtypes)["doc_id"] in ("int", "bigint")
    run = F.shiftright(F.col("doc_id"), 12) if numeric else F.substring("doc_id", F.lit(1), F.length("doc_id") - 3)
    sizes = words.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("run", run)
    runs = sizes.groupBy("run").agg(F.sum("n").alias("n"))
    order = [F.length("run"), "run"] if not numeric else ["run"]
    runs = runs.select("run", (F.sum("n").over(Window.orderBy(*order)) - F.col("n")).alias("runs_before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    before = sizes.join(runs, "run").select("doc_id", (F.col("runs_before") + F.sum("n").over(Window.partitionBy("run").orderBy("doc_id")) - F.col("n")).alias("before"), "all")
    first = inside.join(before, "doc_id").groupBy("w").agg(F.min(F.col("before") + F.col("i")).alias("born"), F.first("all").alias("all"))
    marks = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.greatest(F.lit(1), F.floor(F.col("all") * k / steps)).cast("long")))
    born = first.select(F.array_min(F.filter(marks, lambda m: m >= F.col("born"))).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))
    return born.select("tokens", F.sum("n").over(Window.orderBy("tokens")).alias("vocabulary"))  # a row for each mark


def power_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """(K, beta) of y = K x^beta by least squares on logarithms."""
    return points.agg(F.round(F.exp(F.regr_intercept(F.ln(y), F.ln(x))), 2).alias("K"), F.round(F.regr_slope(F.ln(y), F.ln(x)), 3).alias("beta"))


def histogram(values: DataFrame, c: str, width: int = 5, cap: int = 80) -> DataFrame:
    """(bin, n) with all bins from 0 to cap, the empty ones too."""
    bins = values.sparkSession.range(0, cap + 1, width).select(F.col("id").alias("bin"))
    got = values.select((F.floor(F.least(F.col(c), F.lit(cap)) / width) * width).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def tokenizer_counts(toks: DataFrame, name: str) -> DataFrame:
    return toks.agg(F.count("*").alias("tokens"), F.countDistinct("surface").alias("dictionary"), F.countDistinct(F.lower("surface")).alias("dictionary_lower"), F.count_if(~F.col("surface").rlike(r"[\p{L}\p{N}]")).alias("punctuation")).select(F.lit(name).alias("tokenizer"), "*")


def case_duplicates(toks: DataFrame) -> DataFrame:
    """Types whose lower-case form is a type too."""
    types = toks.select("surface").distinct()
    upper = types.filter(F.col("surface") != F.lower("surface"))
    return upper.withColumn("low", F.lower("surface")).join(types.select(F.col("surface").alias("low")), "low", "left_semi").select("surface")


def audit(toks: DataFrame) -> DataFrame:
    """(problem, occurrences, examples): seven patterns of previous, current and next token inside sentences."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = toks.select("doc_id", "pos", F.lag("surface").over(w).alias("a"), F.col("surface").alias("b"), F.lead("surface").over(w).alias("c")).filter("a is not null and c is not null")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    digits, letters = lambda x: x.rlike("^[0-9]+$"), lambda x: x.rlike(r"^\p{L}+$")
    tests: dict[str, Column] = {
        "fraction split": (b == "/") & digits(a) & digits(c),
        "hyphenated word split": (b == "-") & letters(a) & letters(c),
        "currency symbol split": b.isin("$", "₹", "€", "£") & c.rlike("^[0-9]"),
        "percent split": (b == "%") & a.rlike("^[0-9]"),
        "abbreviation broken": b.isin("e.g", "i.e", "etc"),
        "contraction split": b.isin("n't", "'s", "'m", "'re", "nt"),
        "operator split from expression": b.isin("+", "=") & a.rlike("^[0-9]") & c.rlike("^[0-9]"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("problem"), v.alias("hit")) for k, v in tests.items()])
    hits = t.select("doc_id", "pos", F.concat_ws(" ", a, b, c).alias("x"), F.explode(rows).alias("r")).select("r.problem", "r.hit", "doc_id", "pos", "x")
    counts = hits.groupBy("problem").agg(F.count_if("hit").alias("occurrences"))
    first = Window.partitionBy("problem").orderBy("doc_id", "pos")
    shown = hits.filter("hit").withColumn("n", F.row_number().over(first)).filter("n <= 3").groupBy("problem").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), " | ").alias("examples"))
    return counts.join(F.broadcast(shown), "problem", "left").select("problem", "occurrences", F.coalesce("examples", F.lit("")).alias("examples"))
