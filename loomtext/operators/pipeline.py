"""Analysis pipelines: texts to one long token table, and its derived tables.

``tokens`` has a row for each token: doc_id, sent_no, tok_no, pos, surface, norm, is_word, term
(null if the token is not indexed). Positions run on through a document, count every token, and
skip one after each sentence. They come from array lengths inside the row, so that building the
table needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import tokenizers as T
from ..functions.cleaning import clean_text

STAGES = ["tokenized", "lowercased", "stopwords_removed", "normalized", "index_terms"]


@dataclass(frozen=True)
class Pipeline:
    """A named configuration; ``order`` is stop_then_norm (the surface is tested) or norm_then_stop (the term is)."""

    name: str
    tokenizer: str = "plain"
    stopwords: str = "none"
    normalizer: str = "none"
    order: str = "stop_then_norm"
    sentences: str = "lines"
    compound_parts: bool = False
    posthoc: bool = False
    rules: tuple[str, ...] | None = field(default=None)

    def with_(self, **changes) -> "Pipeline":
        return replace(self, **changes)

    @property
    def stop(self) -> frozenset[str]:
        return N.stopwords(self.stopwords)


# The compared configurations.
PIPELINES = {
    p.name: p
    for p in (
        Pipeline("A", "nltk", "nltk", "porter", "stop_then_norm", "punkt"),
        Pipeline("B", "spacy", "none", "wordnet_pos", "stop_then_norm", "punkt"),
        Pipeline("H", "hybrid", "custom", "spacy", "norm_then_stop", "punkt"),
        Pipeline("C1", "nltk", "nltk", "porter", "norm_then_stop", "punkt"),
        Pipeline("C2", "spacy", "none", "wordnet_nopos", "stop_then_norm", "punkt"),
        Pipeline("C3", "bpe_words", "none", "none", "stop_then_norm", "punkt"),
        Pipeline("H2", "hybrid", "custom", "wordnet_cf", "norm_then_stop", "punkt", True, True),
    )
}


def clean_documents(docs: DataFrame) -> DataFrame:
    """doc_id and cleaned text."""
    fmt = F.col("fmt") if "fmt" in docs.columns else None
    return docs.select("doc_id", clean_text(F.col("text"), fmt, log=False).alias("text"))


def running_starts(sizes: Column, chunk: int = 256) -> Column:
    """For an array of sizes the sum of those before each.

    Sums inside chunks first, then those of the chunks before are added: an append copies a
    chunk or the list of chunks, never the whole array.
    """
    none = F.array().cast("array<int>")
    inside = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
    places = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(chunk))).otherwise(none)
    parts = F.transform(places, lambda i: inside(F.slice(sizes, i, chunk)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(p["out"], lambda x: x + a["at"]))).alias("out"))
    return F.flatten(F.aggregate(parts, start, step)["out"])


def positioned(docs: DataFrame, tokenizer: str = "plain", sentences: str = "lines", rules: list[str] | None = None) -> DataFrame:
    """doc_id, sent_no, tok_no, pos, surface for every token."""
    sents = docs.select("doc_id", T.split_sentences(F.col("text"), sentences).alias("sents"))
    if tokenizer == "hybrid":  # the Arrow UDF sees a sentence at a time
        sents = sents.select("doc_id", F.posexplode("sents").alias("sent_no", "s")).select("doc_id", "sent_no", T.tokenize(F.col("s"), tokenizer, rules).alias("toks"))
        sents = sents.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sent_no", "toks"))), lambda x: x["toks"]).alias("toks"))
    else:
        sents = sents.select("doc_id", F.transform("sents", lambda s: T.tokenize(s, tokenizer, rules)).alias("toks"))
    sents = sents.withColumn("first", running_starts(F.transform("toks", lambda t: F.size(t) + 1)))
    each = sents.select("doc_id", F.posexplode(F.arrays_zip("toks", "first")).alias("sent_no", "z"))
    return each.select("doc_id", "sent_no", F.col("z.first").alias("first"), F.posexplode("z.toks").alias("tok_no", "surface")).select("doc_id", "sent_no", "tok_no", (F.col("first") + F.col("tok_no")).alias("pos"), "surface")


def tokens(docs: DataFrame, p: Pipeline) -> DataFrame:
    """The token table of a pipeline over (doc_id, text)."""
    return with_terms(positioned(docs, p.tokenizer, p.sentences, None if p.rules is None else list(p.rules)), p)


def with_terms(t: DataFrame, p: Pipeline) -> DataFrame:
    """Adds norm, is_word, is_stop and term, which depend on the surface alone."""
    t = N.add_norm(t, p.normalizer)
    checked = F.lower("surface") if p.order == "stop_then_norm" else F.col("norm")
    t = t.withColumn("is_word", N.is_word(F.col("surface"))).withColumn("is_stop", N.in_list(checked, p.stop))
    return t.withColumn("term", F.when(F.col("is_word") & ~F.col("is_stop"), F.col("norm")))


def surfaces(docs: DataFrame, p: Pipeline) -> DataFrame:
    """(surface): the distinct surfaces of a pipeline's tokens, each once."""
    rules = None if p.rules is None else list(p.rules)
    sents = docs.select(F.explode(T.split_sentences(F.col("text"), p.sentences)).alias("s"))
    if p.tokenizer != "hybrid":
        return sents.select(F.explode(T.tokenize(F.col("s"), p.tokenizer, rules)).alias("surface")).distinct()

    def run(batches):  # a batch's tokens go back once each
        for b in batches:
            pieces = {p for s in set(b.column(0).to_pylist()) for p in T.PIECES.split(s)}
            found = {t for p in pieces for t in T.hybrid_tokens(p, rules)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["surface"])

    return sents.mapInArrow(run, "surface string").distinct()


def postings(toks: DataFrame, p: Pipeline) -> DataFrame:
    """(term, doc_id, pos, surface): the indexed terms, with the parts of hyphenated compounds where asked for."""
    terms = toks.filter("term is not null").select("term", "doc_id", "pos", F.lower("surface").alias("surface"))
    if not p.compound_parts:
        return terms
    cut = F.filter(F.array_distinct(F.transform(F.split(F.lower("surface"), "-"), N.normalize_term)), lambda x: x.rlike(r"[\p{L}\p{N}]") & ~N.in_list(x, p.stop))
    parts = toks.filter(F.col("term").isNotNull() & F.col("surface").contains("-") & F.col("surface").rlike("[A-Za-z]"))
    parts = parts.select(F.explode(cut).alias("part"), "term", "doc_id", "pos", F.lower("surface").alias("surface")).filter("part <> term")
    return terms.union(parts.select(F.col("part").alias("term"), "doc_id", "pos", "surface"))


def by_form(toks: DataFrame) -> DataFrame:
    """(surface, norm, is_stop, term, n): the tokens by their form, from which counts of types are taken."""
    return toks.groupBy("surface", "norm", "is_stop", "term").agg(F.count("*").alias("n"))


def stage_counts(toks: DataFrame) -> DataFrame:
    """(stage, tokens, vocabulary): tokens are grouped by form once, types are counted over the forms."""
    forms, low = by_form(toks), F.lower("surface")
    kinds = [("tokenized", F.col("surface"), None), ("lowercased", low, None), ("stopwords_removed", low, ~F.col("is_stop")), ("normalized", F.col("norm"), None), ("index_terms", F.col("term"), None)]
    # Each form goes under every stage that keeps it; forms are few beside tokens.
    tagged = forms.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), (v if kept is None else F.when(kept, v)).alias("v")) for name, v, kept in kinds])).alias("x")).select("n", "x.*").filter("v is not null")
    return tagged.groupBy("stage", "v").agg(F.sum("n").alias("n")).groupBy("stage").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))


def sentence_streams(toks: DataFrame) -> DataFrame:
    """(doc_id, sent_no, toks): normalised tokens before stop words are removed."""
    value = F.when(F.col("is_word"), F.col("norm")).otherwise(F.col("surface"))
    return toks.groupBy("doc_id", "sent_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("tok_no", value.alias("t")))), lambda x: x["t"]).alias("toks"))


def native_streams(docs: DataFrame, p: Pipeline) -> DataFrame:
    """(toks): the arrays of ``sentence_streams`` from the texts themselves, without a shuffle; for normalisers that are column expressions."""
    if p.normalizer not in N._NATIVE:
        raise ValueError(f"{p.normalizer} is no column expression")
    rules = None if p.rules is None else list(p.rules)
    sents = docs.select(F.explode(T.split_sentences(F.col("text"), p.sentences)).alias("s")).select(T.tokenize(F.col("s"), p.tokenizer, rules).alias("toks"))
    norm = lambda t: N.normalize_term(N.NORMALIZERS[p.normalizer](F.lower(t)))
    return sents.select(F.transform("toks", lambda t: F.when(N.is_word(t), norm(t)).otherwise(t)).alias("toks"))


def fingerprint(docs: DataFrame) -> str:
    """A digest of a corpus that does not depend on the order of its rows; a key for stored tables."""
    r = docs.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()
    return f"{r[0]:x}-{(int(r[1] or 0)) & (1 << 64) - 1:x}"


def stored_tokens(docs: DataFrame, p: Pipeline, folder: str) -> DataFrame:
    """The token table, written once for each corpus and configuration, and read from then on."""
    from pyspark.sql.utils import AnalysisException

    rules = "all" if p.rules is None else "+".join(p.rules) or "none"
    spark, path = docs.sparkSession, f"{folder}/{fingerprint(docs)}-{p.tokenizer}-{rules}-{p.sentences}-{p.normalizer}-{p.stopwords}-{p.order}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        tokens(docs, p).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
