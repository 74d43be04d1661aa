"""Queries that SQL cannot express, and operators without a query, against plain Python on small data."""

import collections
import inspect
import json
import os
import re
import time
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from loomtext.functions import cleaning as C
from loomtext.functions import normalize as N
from loomtext.functions import tokenizers as K
from loomtext.operators import bpe, entities, evaluate, evidence, experiments, tagging
from loomtext.operators import pipeline as P
from loomtext.operators.index import PositionalIndex
from loomtext.operators.search import Engine
from loomtext.plans import catalog
from loomtext.sources import loaders as L
from loomtext.sources import sinks

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in catalog.docs(spark, SF).collect()}


def rows(df):
    return {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}


# ---- cleaning and tokenizers over the whole table
@tables
def test_nfkc(spark, texts):
    got = {r.doc_id: (r.text_md5, r.changed) for r in catalog.QUERIES["nfkc"](spark, SF).collect()}
    import hashlib

    for k, t in texts.items():
        n = unicodedata.normalize("NFKC", t).replace("⁄", "/")
        assert got[k] == (hashlib.md5(n.encode()).hexdigest(), sum(a != b for a, b in zip(t, n)) + abs(len(t) - len(n)))


@tables
def test_clean_log(spark, texts):
    """Counts of the steps, each on what the one before left, with Python's regular expressions."""
    got = {r.doc_id: r for r in catalog.QUERIES["clean_log"](spark, SF).collect()}
    for k, t in texts.items():
        r = got[k]
        glyphs = "".join(C.VULGAR)
        assert r.vulgar_fractions == len(re.findall(f"[{glyphs}]", t))
        for g, s in C.VULGAR.items():
            t = re.sub(f"([0-9]){g}", rf"\1 {s}", t).replace(g, s)
        n = unicodedata.normalize("NFKC", t).replace("⁄", "/")
        assert r.unicode_nfkc == sum(a != b for a, b in zip(t, n)) + abs(len(t) - len(n))
        t = n
        assert r.typography == sum(t.count(g) for g in C.TYPOGRAPHY)
        for g, s in C.TYPOGRAPHY.items():
            t = t.replace(g, s)
        t, n = re.subn(r"([a-z])-\n[ \t\n\x0b\f\r]*([a-z])", r"\1\2", t)
        assert r.dehyphenate == n
        m = re.search(r"\n\s*(References|Bibliography|REFERENCES)\s*\n", t)
        cut = m is not None and m.start() > 0.4 * len(t)
        assert r.references == (len(t) - m.start() if cut else 0)
        t = t[: m.start()] if cut else t
        t, n = re.subn(r"https?://[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+", " ", t)
        assert r.urls == n and r.page_numbers == 0
        assert r.emoji == len(re.findall("[\U0001f300-\U0001faff☀-➿\U0001f000-\U0001f2ff]", t))


@tables
@pytest.mark.parametrize("name", ["custom", "hybrid"])
def test_rule_tokenizers(spark, texts, name):
    """Java's engine against Python's, token by token; the merging tokenizer keeps every character that is no blank."""
    got = {r.token: r.n for r in catalog.QUERIES[f"tok_{name}"](spark, SF).collect()}
    pattern = regex.compile(K.alternation())
    want = collections.Counter()
    for t in texts.values():
        tokens = [m.group() for m in pattern.finditer(t)] if name == "custom" else K.hybrid_tokens(t)
        if name == "hybrid":
            spans = K.hybrid_spans(t)
            assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:]))
        want.update(tokens)
    assert got == dict(want)


def test_positions_of_many_lines(spark):
    d = spark.createDataFrame([(1, "\n".join(["a b"] * 60_000)), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    start = time.perf_counter()
    r = P.positioned(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").alias("m"), F.sum("pos").alias("s")).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n, x.m) for x in r] == [(1, 120_000, 179_998), (4, 1, 0)] and r[0].s == sum(3 * i + j for i in range(60_000) for j in (0, 1))
    assert time.perf_counter() - start < 20


# ---- stems, lemmas, vocabularies
@tables
@pytest.mark.parametrize("name, f, stop, order", [("porter", N.porter, "nltk", "stop"), ("lemma_context_free", N.lemma_context_free, "custom", "norm")])
def test_normalised_terms(spark, texts, name, f, stop, order):
    want = collections.Counter()
    for t in texts.values():
        for w in regex.findall(K.PLAIN, t):
            if not regex.search(r"[\p{L}\p{N}]", w):
                continue
            low = w.lower()
            norm = f(low)
            norm = norm[:-2] if norm.endswith("'s") and len(norm) > 3 else norm
            if (low if order == "stop" else norm) not in N.stopwords(stop):
                want[norm] += 1
    assert {r.term: r.n for r in catalog.QUERIES[name](spark, SF).collect()} == dict(want)


def naive_merges(counts, n):
    words, out = {tuple([*w, bpe.END]): c for w, c in counts.items()}, []
    for _ in range(n):
        pairs = collections.Counter()
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        out.append(best)
        merged = {}
        for w, c in words.items():
            x, i = [], 0
            while i < len(w):
                both = w[i : i + 2] == best
                x.append("".join(best) if both else w[i])
                i += 2 if both else 1
            merged[tuple(x)] = merged.get(tuple(x), 0) + c
        words = merged
    return out


@tables
def test_bpe(spark, texts):
    counts = collections.Counter(w for t in texts.values() for w in re.findall("[a-z]+|[0-9]+", t.lower()))
    want = naive_merges(counts, 25)
    got = [(r.a, r.b) for r in catalog.QUERIES["bpe_train"](spark, SF).orderBy("step").collect()]
    assert got[:25] == want and len(got) == 300
    m = bpe.Merges(got)

    def encode(w):  # apply every merge in turn
        s = [*w, bpe.END]
        for a, b in got:
            i, out = 0, []
            while i < len(s):
                both = i + 1 < len(s) and (s[i], s[i + 1]) == (a, b)
                out.append(a + b if both else s[i])
                i += 2 if both else 1
            s = out
        return s

    some = sorted(counts)[::40]
    assert all(m.encode_word(w) == encode(w) for w in some)
    pieces = {r.doc_id: r.pieces for r in catalog.QUERIES["bpe_encode"](spark, SF).collect()}
    assert all(pieces[k] == sum(len(m.encode_word(w)) for w in re.findall("[a-z]+|[0-9]+", t.lower())) for k, t in [*texts.items()][::9])
    c = bpe.curve(catalog.docs(spark, SF), m, (100, 250)).collect()
    assert [(r.merges, r.corpus_tokens) for r in c] == [(n, sum(k * len(bpe.Merges(got[:n]).encode_word(w)) for w, k in counts.items())) for n in (100, 250)]
    assert bpe.word_pieces(["the", "1/2"], {"m": m})[1]["m"] == m.encode_word("1") + m.encode_word("2")


def test_bpe_keeps_words_on_the_cluster(spark, monkeypatch):
    words = ["".join(chr(97 + (i * k) % 7) for k in range(1, 2 + i % 9)) + str(i * 37 % 1999) for i in range(4000)] + ["aaaa", "aaa", "aaaaa", "abab", "babab"] * 9
    d = spark.createDataFrame([(i, " ".join(words[i::40])) for i in range(40)] + [(99, None), (100, "")], "doc_id long, text string")
    counts = dict(sorted(collections.Counter(x for w in words for x in re.findall("[a-z]+|[0-9]+", w)).items()))
    seen, frame = [], type(d)
    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), **b: (rows := [*f(self, *a, **b)], seen.extend(r for r in rows if "word" in r or "symbols" in r))[0])
    few = {"frequent": 100, "store_every": 7} if "frequent" in inspect.signature(bpe.train).parameters else {}
    got = bpe.train(d, 60, **few)
    want = bpe.Merges.train(counts, 60)
    assert (got.merges, got.symbols, got.history) == (want.merges, want.symbols, want.history)
    assert len(seen) <= 100 < len(counts)
    assert bpe.train(d.limit(0), 5).merges == []


def test_piece_counts(spark):
    m = bpe.Merges.train({"low": 5, "lower": 2}, 3)
    d = spark.createDataFrame([(1, ["low", "lower", "low"]), (2, []), (3, None), (4, ["x"])], "id long, w array<string>")
    want = {r.id: len(r.p) for r in d.filter("w is not null").select("id", m.encode(F.col("w")).alias("p")).collect()} | {3: None}
    assert {r.id: r.n for r in d.select("id", m.piece_counts(F.col("w")).alias("n")).collect()} == want


@tables
def test_variants_count_in_one_aggregate(spark):
    """Shuffles before the counts: the old plan grouped all tokens by sentence nine times and counted nine times."""
    plan = catalog.QUERIES["ngram_variants"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 0 and plan.count("Aggregate [n#") <= 3


@tables
def test_hybrid_by_piece(texts):
    import random

    rng = random.Random(3)
    parts = ["1", "2/3", " ", "  ", "\t", "\x1f", "$", "₹", "5,000", "3/4,", "1/2", "isn't", "e.g.", "A.B.", "http://a b", "x+1=2", "10:30", "2nd", "well-known", "dont", "٣", "...", "50%,60%", "a@b.c", ".5", "-", "'"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    for t in made + [s for x in [*texts.values()][:60] for s in x.split("\n")]:
        assert K.piece_tokens(t) == K.hybrid_tokens(t)


@tables
def test_comparison_makes_only_the_queries_postings(spark, monkeypatch):
    """The old way built and sorted every pipeline's whole index; vocabularies and scores are those of whole indexes still."""
    d = catalog.docs(spark, SF).limit(60).cache()
    qrels = d.select(F.lit(0).alias("qid"), "doc_id", (F.col("doc_id") % 2).alias("relevant"))
    names, queries = ["A", "C1", "H2"], [(0, "rights OR water AND NOT idiot")]
    want = {}
    for n in names:
        ix = PositionalIndex.build(d, P.PIPELINES[n])
        scores = evaluate.retrieval_scores(experiments.search_many(Engine(ix), queries, limit=None), qrels)
        want[n] = (scores.first().f1, ix.terms().count())
    monkeypatch.setattr(PositionalIndex, "build", None)
    got = {r.name: (r.f1, r.vocabulary) for r in experiments.compare(d, names, queries, qrels).collect()}
    assert {n: (round(f, 4), v) for n, (f, v) in want.items()} == got


def test_byte_bpe(spark):
    d = spark.createDataFrame([(i, "low lower lowest newer wider") for i in range(20)] + [(99, None)], "doc_id long, text string")
    t = bpe.train_bytes(d, 300)
    assert t.encode("low").tokens == ["Ġlow"] and t.get_vocab_size() <= 300
    assert bpe.train_bytes(d.limit(0), 300).get_vocab_size() >= 1


def test_word_level_round_trip(spark):
    d = spark.createDataFrame([(1, "Hello, world. Is this-- a test?")], "doc_id long, text string")
    v = bpe.vocabulary(d)
    r = bpe.encode_words(d, v).orderBy("i").collect()
    assert [x.token for x in r] == ["Hello", ",", "world", ".", "Is", "this", "--", "a", "test", "?"]
    unknown = bpe.encode_words(spark.createDataFrame([(1, "Hello zzz")], "doc_id long, text string"), v).orderBy("i").collect()
    assert unknown[0].id != unknown[1].id == v.filter(F.col("token") == bpe.UNKNOWN).first().id
    assert spark.createDataFrame([(["Hello", ",", "world", "."],)], "w array<string>").select(bpe.decode(F.col("w")).alias("t")).first().t == "Hello, world."


# ---- tags, entities, evidence
@tables
def test_phrases(spark):
    tagged = tagging.rule_tags(catalog.toks(spark, SF)).orderBy("doc_id", "sent_no", "tok_no").select("doc_id", "sent_no", "surface", "tag").collect()
    sents = collections.defaultdict(list)
    for r in tagged:
        sents[r.doc_id, r.sent_no].append((r.surface, r.tag))
    phrases, pairs = collections.Counter(), collections.Counter()
    for s in sents.values():
        kind = ["d" if t in ("DT", "PRP$") else t[0].lower() if t[:2] in ("JJ", "NN", "VB") else "o" for _, t in s]
        i = 0
        while i < len(s):
            at = i
            i += kind[i] == "d"
            while i < len(s) and kind[i] == "j":
                i += 1
            nouns = i
            while i < len(s) and kind[i] == "n":
                i += 1
            if i > nouns:
                phrases[" ".join(w for w, _ in s[at:i])] += 1
                if at and kind[at - 1] == "v":
                    pairs[s[at - 1][0], s[i - 1][0]] += 1
            else:
                i = at + 1
    assert {r.phrase: r.n for r in catalog.QUERIES["noun_phrases"](spark, SF).collect()} == dict(phrases)
    got = {(r.verb, r.object): r.n for r in catalog.QUERIES["verb_objects"](spark, SF).collect()}
    assert got == dict(pairs)


@tables
def test_entity_ruler(spark, texts):
    want = collections.Counter()
    for k, t in texts.items():
        for m in re.finditer(r"(?i)(?<![\w-])(mit licenses?|general public licenses?|rights?)(?![\w-])|(?<![\w-])CC(?![\w-])", t):
            want[k, m.start(), m.group()] += 1
    got = collections.Counter((r.doc_id, r.start, r.text) for r in catalog.QUERIES["entity_ruler"](spark, SF).collect() if r.label != "MONEY" and r.label != "DATE")
    assert got == want


def test_marked_entities(spark):
    d = spark.createDataFrame([("a <b> DKT model & so", [("DKT", "KT_MODEL", 6, 9, "ruler")]), ("none", [])], "text string, e array<struct<text: string, label: string, start: int, end: int, source: string>>")
    got = [r.h for r in d.select(entities.marked_html(F.col("text"), F.col("e")).alias("h")).collect()]
    assert got == ['<div class="entities">a &lt;b&gt; <mark style="background: #e0d4ff">DKT <span>KT_MODEL</span></mark> model &amp; so</div>', '<div class="entities">none</div>']


def test_detect_in_documents(spark):
    """Claims inside longer texts; the table itself holds none."""
    d = spark.createDataFrame([(1, "first 1/2+1/3=2/5. Then 0.3 x 0.2 = 0.6!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = d.select("doc_id", F.explode(evidence.detect(F.col("text"))).alias("x")).select("doc_id", "x.*").collect()
    assert [(r.doc_id, r.span, r.strength) for r in got] == [(1, "1/2+1/3=2/5", 0.9), (1, "0.3 x 0.2 = 0.6", 0.8)]


def test_evidence_records(spark, tmp_path):
    """The whole record of every document against plain Python: id, findings and the five nearest items."""
    import hashlib
    import math

    items = ["1/2 + 1/3 is a sum of fractions", "the larger denominator", "which decimal is bigger", "tops and bottoms", "add the tops", "multiply 0.3 x 0.2", "fractions and decimals"]
    claims = [(i, c) for i, (c, _) in enumerate(catalog.CLAIMS)] + [(90, None), (91, ""), (92, "the  larger decimal is in the sum of fractions and the tops")]
    spark.createDataFrame(claims, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in catalog.QUERIES["evidence_records"](spark, f"{tmp_path}").collect()}
    assert sorted(got) == sorted(i for i, _ in claims)

    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    df = collections.Counter(g for t in items for g in grams(t))

    def vector(t):
        v = {g: (1 + math.log(n)) * (math.log((1 + len(items)) / (1 + df[g])) + 1) for g, n in grams(t).items() if g in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    for i, text in claims:
        x, clean = json.loads(got[i].interpretation), None if text is None else re.sub(" +", " ", text)
        expected = catalog.CLAIMS[i][1] if i < 90 else ""
        assert "; ".join(d["hypothesis"] for d in x.get("detectors") or []) == expected
        assert got[i].evidence_id == (None if text is None else "E_" + hashlib.sha1(clean.encode()).hexdigest()[:10])
        own = vector(clean or "")
        near = [(round(sum(x * own.get(g, 0) for g, x in vector(t).items()), 4), -k) for k, t in enumerate(items)]
        want = [(-k, s) for s, k in sorted(near, reverse=True)[:5] if s > 0]
        assert [(g["item_id"], g["score"]) for g in x.get("retrieved_grounding") or []] == want


@tables
@pytest.mark.parametrize("name, kind", [("backoff_tags", tagging.BackoffTagger), ("hmm_tags", tagging.HmmTagger)])
def test_tags_of_all_sentences(spark, name, kind):
    """The counts of tags against the same model called on one sentence after another."""
    d = catalog.docs(spark, SF)
    model = kind(tagging.tagged_sample(d, catalog.PLAIN))
    sentences = d.select(F.explode(K.split_sentences(F.col("text"), catalog.PLAIN.sentences)).alias("s")).select(K.tokenize(F.col("s"), catalog.PLAIN.tokenizer).alias("w"))
    want = collections.Counter(t for r in sentences.collect() for t in model.tag(list(r.w)))
    assert {r.tag: r.n for r in catalog.QUERIES[name](spark, SF).collect()} == dict(want)


def test_tag_all(spark):
    d = spark.createDataFrame([(1, "Simplify 3/4 x 1/2"), (2, "the top number")], "doc_id long, text string")
    model = tagging.BackoffTagger([[("the", "DT"), ("top", "NN")]])
    t = tagging.tag_all(P.positioned(d, "whitespace"), {"backoff": model.column}).orderBy("doc_id", "tok_no").collect()
    assert [(r.surface, r.base, r.rules, r.backoff) for r in t] == [("Simplify", "NNP", "VB", "NNP"), ("3/4", "CD", "CD", "CD"), ("x", "NN", "SYM", "NN"), ("1/2", "CD", "CD", "CD"), ("the", "DT", "DT", "DT"), ("top", "NN", "JJ", "NN"), ("number", "NN", "NN", "NN")]


# ---- index, store and comparison
def test_index_files(spark, tmp_path):
    p = P.Pipeline("x", stopwords="nltk")
    d = spark.createDataFrame([(1, "the red fox and the red hen"), (2, "a hen"), (70_000, "red"), (4, "")], "doc_id long, text string")
    ix = PositionalIndex.build(d, p)
    again = sinks.stored_index(ix, f"file://{tmp_path}/ix")
    back = sinks.index_from_json(sinks.index_json(ix), d, p)
    for other in (again, back):
        assert rows(other.tfidf().withColumn("tfidf", F.round("tfidf", 9))) == rows(ix.tfidf().withColumn("tfidf", F.round("tfidf", 9)))
        assert [(r.doc_id, r.score) for r in Engine(other).search('"red hen"').collect()] == [(r.doc_id, r.score) for r in Engine(ix).search('"red hen"').collect()]
        assert {(r.doc_id, r.doc_len) for r in other.doc_len().collect()} == {(1, 4), (2, 1), (70_000, 1), (4, 0)}
    assert {(r.term, r.block) for r in sinks.index_json(ix).collect()} == {("red", 0), ("red", 1), ("fox", 0), ("hen", 0)}
    plan = again.postings.filter("term = 'red'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,red)]" in plan


def test_stored_tokens(spark, tmp_path):
    d = spark.createDataFrame([(1, "a 5% cut of 3/4")], "doc_id long, text string")
    p = P.Pipeline("x", tokenizer="custom")
    folder = f"file://{tmp_path}"
    for rules in (None, ("percent",), (), ("fraction",), None):
        own = p.with_(rules=rules)
        assert rows(P.stored_tokens(d, own, folder)) == rows(P.tokens(d, own)), rules


def test_compare_scores_whole_rankings(spark):
    """Two pipelines' means against rankings scored by hand, more hits than any usual limit."""
    n = 1200
    d = spark.createDataFrame([(i, "red fox " * (1 + i % 3) + ("hen" if i % 2 else "")) for i in range(n)], "doc_id long, text string")
    qrels = spark.createDataFrame([(0, i, int(i % 5 == 0)) for i in range(n)], "qid int, doc_id long, relevant int")
    got = {r["name"]: r for r in experiments.compare(d, ["A", "C1"], [(0, "fox")], qrels).collect()}
    ranked = range(n)  # the term is in every document: all scores are zero, ties by id
    hits = [int(i % 5 == 0) for i in ranked]
    p, r = sum(hits) / n, 1.0
    ap = sum(sum(hits[: k + 1]) / (k + 1) for k in range(n) if hits[k]) / sum(hits)
    for name in ("A", "C1"):
        assert (got[name].precision, got[name].recall, got[name].f1, got[name].ap, got[name].p_at_5) == (p, r, round(2 * p * r / (p + r), 4), round(ap, 4), 0.2)
        assert got[name].vocabulary == 3
    turned = experiments.measures_by_pipeline(experiments.compare(d, ["A", "C1"], [(0, "fox")], qrels), ["A"]).collect()
    assert [(x.measure, x.pipeline_a, x.final) for x in turned][1] == ("precision", p, p)


def test_search_with_repeated_words_and_long_phrases(spark):
    long = " ".join(f"w{i}" for i in range(80))
    d = spark.createDataFrame([(1, "a b a b c"), (2, "a b c a"), (3, f"x {long}")], "doc_id long, text string")
    e = Engine(PositionalIndex.build(d, P.Pipeline("x")))
    assert [r.doc_id for r in e.search('"a b a"').collect()] == [1]
    assert [r.doc_id for r in e.search(f'"{long}"').collect()] == [3]
    assert {r.doc_id for r in e.search('"a b c" OR "b a"').collect()} == {1, 2}


def test_curve_at_k_does_not_depend_on_order(spark):
    ranked = spark.createDataFrame([(q, 10 * q + k, k + 1) for q in range(7) for k in range(10)], "qid int, doc_id long, rank int")
    qrels = spark.createDataFrame([(q, 10 * q + k, int((q + k) % 3 == 0)) for q in range(7) for k in range(10)], "qid int, doc_id long, relevant int")
    got = {r.k: (r.p, r.r) for r in evaluate.curve_at_k(ranked, qrels).collect()}
    for k in range(1, 11):
        p = sum(round(sum((q + j) % 3 == 0 for j in range(k)) / k * 10_000) for q in range(7)) / 7 / 10_000
        assert got[k][0] == pytest.approx(p, abs=6e-5)


# ---- files
def test_corpus_and_sinks(spark, tmp_path):
    (tmp_path / "D01_a.txt").write_text("one two")
    (tmp_path / "D02_b.md").write_text("# T\n**b**")
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / "catalog.csv").write_text("doc_id,title,layer,source,licence,synthetic\nD01,First,core,here,CC0,no\n")
    c = L.read_catalog(spark, f"file://{tmp_path}/catalog.csv")
    got = {r.doc_id: r for r in L.load_corpus(spark, f"file://{tmp_path}", c).collect()}
    assert set(got) == {"D01", "D02"} and got["D01"].title == "First" and got["D01"].meta["licence"] == "CC0" and got["D02"].title == "T"
    assert {r.filename for r in L.load_corpus(spark, f"file://{tmp_path}").collect()} == {"D01_a.txt", "D02_b.md"}
    d = spark.createDataFrame([(1, "x, y"), (2, 'q"')], "a long, b string")
    sinks.write_csv(d, f"file://{tmp_path}/out.csv")
    assert rows(spark.read.csv(f"file://{tmp_path}/out.csv", header=True, schema="a long, b string", escape="\\")) == rows(d)
    sinks.write_json(d, f"file://{tmp_path}/out.json")
    assert rows(spark.read.schema("a long, b string").json(f"file://{tmp_path}/out.json")) == rows(d)
    words = N.write_stopwords(str(tmp_path / "stop.txt"))
    assert (tmp_path / "stop.txt").read_text().split() == words == sorted(N.stopwords("custom"))


@tables
def test_html_title(spark):
    got = {r.page_id: r for r in catalog.QUERIES["html_title"](spark, SF).collect()}
    import html

    for r in catalog.table(spark, SF, "pages").collect():
        page = r.html or ""
        m = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
        assert got[r.page_id].title == (" ".join(html.unescape(m[1]).split()) if m else "")
        assert got[r.page_id].chars <= len(page)


def test_penn_to_wordnet(spark):
    d = spark.createDataFrame([(t,) for t in ("JJ", "VBD", "RB", "NNS", "XX")], "t string")
    assert [r.p for r in d.select(N.penn_to_wordnet(F.col("t")).alias("p")).collect()] == ["a", "v", "r", "n", "n"]
