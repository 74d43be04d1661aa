"""The operations of the service as Python functions over a session: inputs are checked, results are DataFrames or rows."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as N
from .functions import tokenizers as K
from .functions.cleaning import clean_text
from .operators import bpe, entities, evidence, tagging
from .operators import pipeline as P
from .operators.index import PositionalIndex
from .operators.search import Engine, classify, snippet
from .sources import loaders

UPLOAD_BYTES = 15 << 20


class Service:
    """Documents (doc_id, text, ...) and the indexes over them, each built once."""

    def __init__(self, docs: DataFrame, clean: bool = True):
        self.raw = docs
        self.docs = P.clean_documents(docs).persist() if clean else docs.select("doc_id", "text").persist()
        self._engines: dict[str, Engine] = {}

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def engine(self, pipeline: str | P.Pipeline = "A") -> Engine:
        p = P.PIPELINES[pipeline] if isinstance(pipeline, str) else pipeline
        key = repr(p)
        if key not in self._engines:
            self._engines[key] = Engine(PositionalIndex.build(self.docs, p).cache())
        return self._engines[key]

    def meta(self) -> dict:
        return {"tokenizers": sorted(K.TOKENIZERS), "normalizers": sorted(N.NORMALIZERS), "pipelines": sorted(P.PIPELINES), "rules": list(K.RULES), "formats": sorted(loaders.SUFFIXES)}

    def document(self, doc_id) -> DataFrame:
        """Raw and cleaned text with the log of the steps."""
        return self.raw.filter(F.col("doc_id") == doc_id).select("doc_id", "text", clean_text(F.col("text")).alias("clean"))

    def upload(self, name: str, content: bytes) -> DataFrame:
        if len(content) > UPLOAD_BYTES:
            raise ValueError("file too large")
        return loaders.load_bytes(self.spark, [(name, content)]).withColumn("clean", clean_text(F.col("text"), F.col("fmt")))

    def search(self, query: str, pipeline: str | P.Pipeline = "A", mode: str = "auto", limit: int = 10) -> DataFrame:
        """(doc_id, score, snippet)"""
        e = self.engine(pipeline)
        words = [w for u in e.analyse(query, mode)[1] if not u.negated for w in u.text.replace('"', " ").split()]
        hits = e.search(query, mode, limit)
        return hits.join(self.docs, "doc_id").select("doc_id", "score", snippet(F.col("text"), words or [query]).alias("snippet")).orderBy(F.desc("score"), "doc_id")

    def query_type(self, query: str) -> str:
        return classify(query)

    def term(self, word: str, pipeline: str | P.Pipeline = "A") -> tuple[DataFrame, DataFrame]:
        e = self.engine(pipeline)
        found = e.analyzer(word)
        return e.index.term(found[0][0] if found else word.lower())

    def index_summary(self, pipeline: str | P.Pipeline = "A") -> dict[str, DataFrame]:
        ix = self.engine(pipeline).index
        totals = ix.terms().agg(F.count("*").alias("terms"), F.sum("cf").alias("postings"))
        return {"totals": totals, "df_histogram": ix.df_histogram(), "heatmap": ix.heatmap()}

    def run_pipeline(self, **config) -> tuple[Engine, DataFrame]:
        """A pipeline of one's own design: its engine and stage counts."""
        known = {f.name for f in fields(P.Pipeline)}
        if wrong := set(config) - known:
            raise ValueError(f"unknown settings: {sorted(wrong)}")
        p = P.Pipeline(**{"name": "own"} | config)
        return self.engine(p), P.stage_counts(P.tokens(self.docs, p))


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("doc_id"), F.lit(text).alias("text"))


def tokenize(spark: SparkSession, text: str, names: list[str], rules: list[str] | None = None) -> DataFrame:
    """(tokenizer, tokens, spans) for several tokenizers; ValueError on an unknown name."""
    one = _one(spark, text)
    parts = [one.select(F.lit(n).alias("tokenizer"), K.tokenize(F.col("text"), n, rules).alias("tokens"), "text") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("tokenizer", "tokens", K.align(F.col("tokens"), F.col("text")).alias("spans"))


def rule_hits(text: str, rules: list[str] | None = None) -> list[dict]:
    return K.rule_hits(text, rules)


def preprocess(spark: SparkSession, text: str, pipeline: P.Pipeline) -> DataFrame:
    """Each token with its forms, whether it is a word or a stop word, and whether its stem is that of a stop word."""
    t = P.tokens(_one(spark, text), pipeline)
    leaks = N.in_list(N.stem_regexp(F.lower("surface")), frozenset(pipeline.stop)) & ~N.in_list(F.lower("surface"), pipeline.stop)
    return t.select("sent_no", "tok_no", "surface", F.lower("surface").alias("low"), "is_word", "is_stop", "norm", "term", leaks.alias("stem_leak"))


def stem(words: list[str]) -> list[dict]:
    """Up to 200 words under the stemmers and lemmas."""
    if len(words) > 200:
        raise ValueError("at most 200 words")
    return [{"word": w, "porter": N.porter(w), "lemma": N.lemma(w), "lemma_context_free": N.lemma_context_free(w)} for w in words]


def pos(spark: SparkSession, text: str) -> DataFrame:
    return tagging.rule_tags(P.positioned(_one(spark, text), "hybrid")).select("sent_no", "tok_no", "surface", "tag", "rule")


def syntax(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Noun phrases and verb-object pairs of the first 3,000 characters (the limit of this call)."""
    t = tagging.rule_tags(P.positioned(_one(spark, text[:3000]), "hybrid"))
    return tagging.noun_phrases(t), tagging.verb_object_pairs(t)


def ner(spark: SparkSession, text: str, lexicon: list[tuple[str, str]]) -> DataFrame:
    return _one(spark, text).select(F.explode(entities.entities(F.col("text"), lexicon)).alias("e")).select("e.*")


def subwords(docs: DataFrame, words: list[str], merges: int = 1000) -> list[dict]:
    """Pieces of up to 80 words under merges learnt from the documents (50 to 4,000)."""
    m = bpe.train(docs, min(4000, max(50, merges)))
    return [{"word": w, "pieces": m.encode_word(w.lower())} for w in words[:80]]


def evidence_record(spark: SparkSession, text: str, catalogue: DataFrame | None = None) -> DataFrame:
    """The record of one utterance of up to 2,000 characters."""
    if len(text) > 2000:
        raise ValueError("at most 2,000 characters")
    return evidence.evidence_records(_one(spark, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), catalogue)
