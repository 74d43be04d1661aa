"""Registry of the engine's queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C
from ..functions import normalize as N
from ..functions import tokenizers as K
from ..operators import bpe, entities, evaluate, evidence, experiments, ngrams, stats, tagging
from ..operators import pipeline as P
from ..operators.index import PositionalIndex, fidelity
from ..operators.search import Engine, snippet
from ..sources import loaders as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PLAIN = P.Pipeline("plain")
STOPPED = P.Pipeline("stopped", stopwords="nltk")
STEMMED = P.Pipeline("stemmed", stopwords="nltk", normalizer="regexp", order="norm_then_stop")


def query(sql: str | None = None):
    """Registers a query under its function's name; whole numbers come out as longs."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c.name).cast("long").alias(c.name) if isinstance(c.dataType, T.IntegerType) else F.col(c.name) for c in df.schema])

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def toks(spark, sf, p: P.Pipeline = PLAIN) -> DataFrame:
    return P.tokens(docs(spark, sf), p)


def index(spark, sf, p: P.Pipeline = PLAIN) -> PositionalIndex:
    return PositionalIndex.build(docs(spark, sf), p)


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


NLTK, CUSTOM = _in(N.stopwords("nltk")), _in(N.stopwords("custom"))


def _tok(pattern: str = K.PLAIN, lines: str = "documents") -> str:
    return f"""
ls AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM {lines}),
sent AS (SELECT doc_id, o - 1 AS sent_no, line FROM ls, unnest(ls) WITH ORDINALITY AS u(line, o)),
tk AS (SELECT doc_id, sent_no, regexp_extract_all(line, '{pattern}') AS t FROM sent),
st AS (SELECT doc_id, sent_no, t, sum(len(t) + 1) OVER (PARTITION BY doc_id ORDER BY sent_no) - (len(t) + 1) AS first FROM tk),
tok AS (SELECT doc_id, sent_no, o - 1 AS tok_no, (first + o - 1)::BIGINT AS pos, s AS surface, lower(s) AS low, regexp_matches(s, '[\\p{{L}}\\p{{N}}]') AS is_word FROM st, unnest(t) WITH ORDINALITY AS u(s, o))"""


TOK = "WITH " + _tok()
_STEM = "CASE WHEN regexp_matches(low, '[A-Za-z]') AND NOT regexp_matches(low, '[0-9]') AND length(low) >= 5 THEN regexp_replace(low, '(ing|ed|es|s)$', '') ELSE low END"
POST = TOK + ",\np AS (SELECT low AS term, doc_id, pos FROM tok WHERE is_word)"
STOPPED_SQL = TOK + f",\np AS (SELECT low AS term, doc_id, pos FROM tok WHERE is_word AND low NOT IN {NLTK})"
STEMMED_SQL = TOK + f",\nq AS (SELECT *, {_STEM} AS norm FROM tok), p AS (SELECT norm AS term, doc_id, pos FROM q WHERE is_word AND norm NOT IN {NLTK})"


# ------------------------------------------------------------------ cleaning
@query("""SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)),
  lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS t FROM documents)""")
def clean_whitespace(spark, sf):
    return docs(spark, sf).select("doc_id", C.whitespace(F.col("text"))[0].alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9][a-z]{3,}')) AS n, md5(regexp_replace(text, '([0-9])([a-z]{3,})', '\\1 \\2', 'g')) AS text_md5 FROM documents""")
def clean_glue(spark, sf):
    t, n = C.digit_word_glue(F.col("text"))
    return docs(spark, sf).select("doc_id", n.alias("n"), F.md5(t).alias("text_md5"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[a-z]-\\n\\s*[a-z]')) AS n, md5(regexp_replace(text, '([a-z])-\\n\\s*([a-z])', '\\1\\2', 'g')) AS text_md5 FROM documents""")
def clean_dehyphenate(spark, sf):
    t, n = C.dehyphenate(F.col("text"))
    return docs(spark, sf).select("doc_id", n.alias("n"), F.md5(t).alias("text_md5"))


@query("""SELECT page_id, len(regexp_extract_all(t, 'https?://\\S+|www\\.\\S+')) AS n, regexp_replace(t, 'https?://\\S+|www\\.\\S+', ' ', 'g') AS cleaned FROM (SELECT page_id, 'see ' || url || ' now' AS t FROM pages)""")
def clean_urls(spark, sf):
    t, n = C.urls(F.concat(F.lit("see "), F.col("url"), F.lit(" now")))
    return table(spark, sf, "pages").select("page_id", n.alias("n"), t.alias("cleaned"))


CLEAN_CASES = [
    ("a\u2028b \u3000c\x0bd", "", "a\nb c\nd"), ("so 😀 good ☀ day", "", "so good day"), ("x\x85\u00a0y", "", "x\ny"),
    ("3½ cups and ¾", "", "3 1/2 cups and 3/4"), ("denomi-\nnator", "", "denominator"), ("see https://a.b/c now", "", "see now"), ("“so” – it’s…", "", '"so" - it\'s...'),
    ("a\n\n\n\nb  c", "", "a\n\nb c"), ("1/8pieces and 2x", "", "1/8 pieces and 2x"), ("one\n12\ntwo", "PDF", "one\n\ntwo"), ("| a | b |\n|---|---|\n- item", "", "a b\nitem"),
    ("a longer body text here\nReferences\nSmith", "", "a longer body text here"),
]


def _values(rows, names: str) -> str:
    def lit(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


def _rows(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"SELECT raw, cleaned FROM {_values([(a, c) for a, _, c in CLEAN_CASES], 'raw, cleaned')}")
def clean_values(spark, sf):
    d = _rows(spark, CLEAN_CASES, "raw string, fmt string, expected string")
    return d.select("raw", C.clean_text(F.col("raw"), F.col("fmt"), log=False).alias("cleaned"))


@query()
def clean_log(spark, sf):
    """Step counts of the whole cleaning function."""
    return docs(spark, sf).select("doc_id", C.clean_text(F.col("text"))["log"].alias("l")).select("doc_id", "l.*")


@query()
def nfkc(spark, sf):
    return docs(spark, sf).select("doc_id", C.nfkc(F.col("text")).alias("n")).select("doc_id", F.md5("n.text").alias("text_md5"), "n.changed")


_HTML_SQL = """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages"""


@query(f"SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM ({_HTML_SQL})")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.html_strip(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars"))


@query(f"SELECT page_id, length(t) AS chars, len(string_split(t, ' ')) AS words, {' + '.join(f'contains(lower(t), {chr(39)}{b.lower()}{chr(39)})::BIGINT' for b in L.BOILERPLATE)} AS boilerplate FROM ({_HTML_SQL})")
def html_compare(spark, sf):
    t = table(spark, sf, "pages").select("page_id", L.html_strip(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("chars"), F.size(F.split("t", " ")).alias("words"), L.boilerplate_found(F.col("t")).alias("boilerplate"))


@query()
def html_title(spark, sf):
    """Main text by the parser."""

    @F.pandas_udf("struct<title: string, text: string>")
    def run(s):
        import pandas as pd

        return pd.DataFrame([L.html_extract(x or "") for x in s], columns=["title", "text"])

    return table(spark, sf, "pages").select("page_id", run("html").alias("x")).select("page_id", "x.title", F.length("x.text").alias("chars"))


# ------------------------------------------------------------------ segmentation
@query(TOK + " SELECT doc_id, sent_no, md5(line) AS line_md5 FROM sent")
def lines_explode(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(K.lines(F.col("text"))).alias("sent_no", "line")).select("doc_id", "sent_no", F.md5("line").alias("line_md5"))


@query("SELECT doc_id, s AS sentence, count(*) AS n FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?]\\s+|\\n'))) AS s FROM documents) WHERE s <> '' GROUP BY ALL")
def sent_naive(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(K.naive_sentences(F.col("text"))).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


def _counts_sql(expr: str) -> str:
    return f"SELECT token, count(*) AS n FROM (SELECT unnest({expr}) AS token FROM documents) GROUP BY token"


def _token_counts(spark, sf, name: str) -> DataFrame:
    return docs(spark, sf).select(F.explode(K.tokenize(F.col("text"), name)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(_counts_sql("list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"))
def tok_whitespace(spark, sf):
    return _token_counts(spark, sf, "whitespace")


@query(_counts_sql(f"regexp_extract_all(text, '{K.WORDPUNCT}')"))
def tok_wordpunct(spark, sf):
    return _token_counts(spark, sf, "nltk_wordpunct")


@query(_counts_sql("regexp_extract_all(lower(text), '[a-z]+|[0-9]+')"))
def pretokenize_counts(spark, sf):
    return _token_counts(spark, sf, "bpe_words")


TOKEN_CASES = [
    ("I ate 3/4 of it", "I|ate|3/4|of|it"), ("3 1/2 is the same as 7/2", "3 1/2|is|the|same|as|7/2"), ("I did 1/2+1/3=2/5, idk", "I|did|1/2+1/3=2/5|,|idk"), ("She paid $3,650 for it", "She|paid|$3,650|for|it"),
    ("a 46% increase", "a|46%|increase"), ("the ratio 3:5", "the|ratio|3:5"), ("on 2026-09-01 we met", "on|2026-09-01|we|met"), ("an LLM-based tutor", "an|LLM-based|tutor"),
    ("mail a.b@x.org today", "mail|a.b@x.org|today"), ("see https://x.org/a?b=1 now", "see|https://x.org/a?b=1|now"), ("the 1st and 2nd", "the|1st|and|2nd"), ("don't you, cant", "don't|you|,|cant"), ("e.g. B.Tech in 0.75 s", "e.g.|B.Tech|in|0.75|s"),
]


@query(f"SELECT text, tokens FROM {_values(TOKEN_CASES, 'text, tokens')}")
def tok_custom_values(spark, sf):
    return _rows(spark, TOKEN_CASES, "text string, e string").select("text", F.array_join(K.custom(F.col("text")), "|").alias("tokens"))


@query()
def tok_custom(spark, sf):
    return _token_counts(spark, sf, "custom")


@query()
def tok_hybrid(spark, sf):
    return _token_counts(spark, sf, "hybrid")


@query(f"SELECT text, n FROM {_values([('pay $3,650 or $5 now', 5), ('1/2 and 3/4', 3), ('a 5% cut', 3)], 'text, n')}")
def rule_switch_values(spark, sf):
    """Tokens with currency left out of the rules, or all others but three."""
    d = _rows(spark, [("pay $3,650 or $5 now",), ("1/2 and 3/4",), ("a 5% cut",)], "text string")
    return d.select("text", F.size(K.custom(F.col("text"), ["currency", "fraction", "percent"])).alias("n"))


@query(f"SELECT text, spans FROM {_values([('I ate 3/4', '0-1 2-5 6-9'), ('a a', '0-1 2-3')], 'text, spans')}")
def align_values(spark, sf):
    d = _rows(spark, [("I ate 3/4",), ("a a",)], "text string")
    spans = K.align(K.whitespace(F.col("text")), F.col("text"))
    return d.select("text", F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ").alias("spans"))


@query(f"SELECT text, joined FROM {_values([('the knowledge tracing model', 'the|knowledge_tracing|model')], 'text, joined')}")
def mwe_values(spark, sf):
    return _rows(spark, [("the knowledge tracing model",)], "text string").select("text", F.array_join(K.mwe(K.whitespace(F.col("text")), ["knowledge tracing"]), "|").alias("joined"))


@query(f"SELECT text, hits FROM {_values([('46% of 3/4', 'percent:46% fraction:3/4')], 'text, hits')}")
def rule_hits_values(spark, sf):
    d = _rows(spark, [("46% of 3/4",)], "text string")
    return d.select("text", F.array_join(F.transform(K.token_rule_hits(F.col("text"), ["percent", "fraction"]), lambda h: F.concat_ws(":", h["rule"], h["text"])), " ").alias("hits"))


def _by_tokenizer(name: str, pattern: str) -> str:
    return f"SELECT '{name}' AS tokenizer, count(*) AS tokens, count(DISTINCT t) AS dictionary, count(DISTINCT lower(t)) AS dictionary_lower, count(*) FILTER (NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) AS punctuation FROM (SELECT unnest({pattern}) AS t FROM documents)"


@query(" UNION ALL ".join([_by_tokenizer("whitespace", "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"), _by_tokenizer("nltk_wordpunct", f"regexp_extract_all(text, '{K.WORDPUNCT}')"), _by_tokenizer("plain", f"regexp_extract_all(text, '{K.PLAIN}')")]))
def token_counts_by_tokenizer(spark, sf):
    out = [stats.tokenizer_counts(docs(spark, sf).select(F.explode(K.tokenize(F.col("text"), n)).alias("surface")), n) for n in ("whitespace", "nltk_wordpunct", "plain")]
    return out[0].union(out[1]).union(out[2])


# ------------------------------------------------------------------ normalisation
@query(TOK + " SELECT surface, CASE WHEN low LIKE '%''s' AND length(low) > 3 THEN left(low, length(low) - 2) ELSE low END AS term, count(*) AS n FROM (SELECT w AS surface, lower(w) AS low FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS w FROM documents)) GROUP BY ALL")
def normalize_term(spark, sf):
    t = docs(spark, sf).select(F.explode(K.whitespace(F.col("text"))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    return t.select("surface", N.normalize_term(F.col("surface")).alias("term"), "n")


@query(TOK + f", q AS (SELECT *, {_STEM} AS norm FROM tok WHERE is_word) SELECT 'stop_then_norm' AS ord, norm AS term, count(*) AS n FROM q WHERE low NOT IN {NLTK} GROUP BY ALL UNION ALL SELECT 'norm_then_stop', norm, count(*) FROM q WHERE norm NOT IN {NLTK} GROUP BY ALL")
def stop_filter_both_orders(spark, sf):
    out = None
    for order in ("stop_then_norm", "norm_then_stop"):
        one = toks(spark, sf, STEMMED.with_(order=order)).filter("term is not null").groupBy("term").agg(F.count("*").alias("n")).select(F.lit(order).alias("ord"), "term", "n")
        out = one if out is None else out.union(one)
    return out


@query(TOK + f" SELECT low AS word, {_STEM} AS stem, count(*) AS n FROM tok WHERE is_word GROUP BY ALL")
def stem_regexp(spark, sf):
    t = toks(spark, sf).filter("is_word").groupBy(F.lower("surface").alias("word")).agg(F.count("*").alias("n"))
    return t.select("word", N.stem_regexp(F.col("word")).alias("stem"), "n")


@query(TOK + f", s AS (SELECT DISTINCT CASE WHEN length(low) >= 5 AND regexp_matches(low, '[A-Za-z]') THEN regexp_replace(low, '(ing|ed|es|s)$', '') ELSE low END AS stem FROM (SELECT unnest([{NLTK[1:-1]}]) AS low)), q AS (SELECT {_STEM} AS norm FROM tok WHERE is_word AND low NOT IN {NLTK}) SELECT norm AS stem, count(*) AS n FROM q WHERE norm IN (SELECT stem FROM s) GROUP BY norm")
def stop_stem_leak(spark, sf):
    """Stems of stop words that the index holds when stop words go first."""
    stop = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(N.stopwords("nltk"))))).alias("w")).select(N.stem_regexp(F.col("w")).alias("term")).distinct()
    t = toks(spark, sf, STEMMED.with_(order="stop_then_norm")).filter("term is not null")
    return t.join(F.broadcast(stop), "term", "left_semi").groupBy(F.col("term").alias("stem")).agg(F.count("*").alias("n"))


@query(TOK + ", y AS MATERIALIZED (SELECT DISTINCT surface, low FROM tok) SELECT a.surface FROM y a SEMI JOIN y b ON a.low = b.surface WHERE a.surface <> a.low")
def case_duplicates(spark, sf):
    return stats.case_duplicates(toks(spark, sf))


@query(TOK + "".join(f"{' UNION ALL' if i else ''} SELECT '{n}' AS list, {k}::BIGINT AS size, count(*) AS tokens, count(DISTINCT low) AS vocabulary FROM tok WHERE is_word AND low NOT IN {s}" for i, (n, k, s) in enumerate((("none", 0, "('')"), ("nltk", len(N.stopwords("nltk")), NLTK), ("custom", len(N.stopwords("custom")), CUSTOM)))))
def stoplist_comparison(spark, sf):
    t = toks(spark, sf).filter("is_word").groupBy(F.lower("surface").alias("w")).agg(F.count("*").alias("n"))
    lists = [(n, N.stopwords(n)) for n in ("none", "nltk", "custom")]
    flags = F.array(*[F.struct(F.lit(n).alias("list"), F.lit(len(s)).alias("size"), N.in_list(F.col("w"), s).alias("hit")) for n, s in lists])
    x = t.select("n", F.explode(flags).alias("f")).filter(~F.col("f.hit"))
    return x.groupBy("f.list", "f.size").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))


@query()
def porter(spark, sf):
    return toks(spark, sf, P.Pipeline("A", stopwords="nltk", normalizer="porter")).filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))


@query()
def lemma_context_free(spark, sf):
    return toks(spark, sf, P.Pipeline("H2", stopwords="custom", normalizer="wordnet_cf", order="norm_then_stop")).filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))


STEMS = [("caresses", "caress", "caress", "caress"), ("relational", "relat", "relat", "rel"), ("generously", "gener", "generous", "gen"), ("knightly", "knightli", "knight", "knight"), ("maximum", "maximum", "maximum", "maxim"), ("presumably", "presum", "presum", "presum"), ("multiply", "multipli", "multipli", "multiply"), ("provision", "provis", "provis", "provid"), ("owed", "ow", "owe", "ow"), ("ear", "ear", "ear", "ear"), ("string", "string", "string", "string"), ("skies", "ski", "sky", "ski"), ("1/2", "1/2", "1/2", "1/2")]


@query(f"SELECT word, porter, snowball, lancaster FROM {_values(STEMS, 'word, porter, snowball, lancaster')}")
def stemmers(spark, sf):
    """Published examples under three stemmers."""
    d = _rows(spark, [(w,) for w, *_ in STEMS], "word string")
    return d.select("word", N.stem_porter(F.col("word")).alias("porter"), N.stem_snowball(F.col("word")).alias("snowball"), N.stem_lancaster(F.col("word")).alias("lancaster"))


STEM_PAIRS = [("fraction", "fractions", 1), ("divide", "dividing", 1), ("add", "added", 1), ("number", "numbers", 1), ("class", "classes", 1), ("numeral", "numerator", 0), ("ratio", "ration", 0), ("use", "used", 1), ("news", "new", 0), ("process", "processes", 1)]


@query(f"SELECT count(*) FILTER (same AND m = 0) AS over_stemmed, count(*) FILTER (NOT same AND m = 1) AS under_stemmed, count(*) AS pairs FROM (SELECT m, CASE WHEN length(a) >= 5 THEN regexp_replace(a, '(ing|ed|es|s)$', '') ELSE a END = CASE WHEN length(b) >= 5 THEN regexp_replace(b, '(ing|ed|es|s)$', '') ELSE b END AS same FROM {_values(STEM_PAIRS, 'a, b, m')})")
def stem_pair_errors(spark, sf):
    d = _rows(spark, STEM_PAIRS, "a string, b string, m int").withColumn("same", N.stem_regexp(F.col("a")) == N.stem_regexp(F.col("b")))
    return d.agg(F.count_if(F.col("same") & (F.col("m") == 0)).alias("over_stemmed"), F.count_if(~F.col("same") & (F.col("m") == 1)).alias("under_stemmed"), F.count("*").alias("pairs"))


# ------------------------------------------------------------------ index
@query(POST + " SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def postings_df_cf(spark, sf):
    return index(spark, sf).terms()


_TFIDF = ", tf AS (SELECT term, doc_id, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), w AS (SELECT tf.term, doc_id, tf, (1 + log10(tf)) * log10(n / df) AS w FROM tf JOIN df USING (term), n)"


@query(STOPPED_SQL + _TFIDF + " SELECT term, doc_id, tf, round(w, 4) AS tfidf FROM w")
def idf_tfidf(spark, sf):
    return index(spark, sf, STOPPED).tfidf().select("term", "doc_id", "tf", F.round("tfidf", 4).alias("tfidf"))


@query(STOPPED_SQL + " SELECT d.doc_id, count(p.term) AS doc_len FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id")
def doc_len(spark, sf):
    return index(spark, sf, STOPPED).doc_len()


@query(TOK + " SELECT doc_id, sent_no, tok_no, pos, surface FROM tok")
def position_assign(spark, sf):
    return toks(spark, sf).select("doc_id", "sent_no", "tok_no", "pos", "surface")


@query(POST + " SELECT doc_id, count(*) AS tf, array_to_string(list(pos ORDER BY pos)[1:50], ' ') AS positions FROM p WHERE term = 'the' GROUP BY doc_id")
def term_lookup(spark, sf):
    found, _ = index(spark, sf).term("the")
    return found.select("doc_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions"))


@query(TOK + " SELECT surface, count(*) AS n FROM (SELECT low AS surface FROM tok WHERE low = 'the') GROUP BY surface")
def surfaces_top(spark, sf):
    return index(spark, sf).term("the")[1]


@query(POST + ", f AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term) SELECT df, count(*) AS terms FROM f GROUP BY df")
def df_histogram(spark, sf):
    return index(spark, sf).df_histogram()


@query(POST + ", t AS (SELECT term FROM p GROUP BY term ORDER BY count(*) DESC, term LIMIT 30), c AS (SELECT term, doc_id, count(*) AS tf FROM p GROUP BY ALL) SELECT t.term, d.doc_id, coalesce(c.tf, 0) AS tf FROM t CROSS JOIN (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN c ON c.term = t.term AND c.doc_id = d.doc_id")
def heatmap_top30(spark, sf):
    return index(spark, sf).heatmap()


@query("WITH w AS (SELECT doc_id, lower(unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))) AS low FROM documents), c AS (SELECT doc_id, low, unnest(list_distinct(string_split(low, '-'))) AS part FROM w WHERE contains(low, '-') AND regexp_matches(low, '[a-z]')) SELECT doc_id, part, count(*) AS n FROM c WHERE regexp_matches(part, '[\\p{L}\\p{N}]') AND part <> low GROUP BY ALL")
def compound_parts(spark, sf):
    p = P.Pipeline("parts", tokenizer="whitespace", compound_parts=True)
    t = toks(spark, sf, p)
    parts = P.postings(t, p).exceptAll(P.postings(t, p.with_(compound_parts=False)))
    return parts.groupBy("doc_id", F.col("term").alias("part")).agg(F.count("*").alias("n"))


@query(TOK + f", q AS (SELECT *, {_STEM} AS norm FROM tok) SELECT 'tokenized' AS stage, count(*) AS tokens, count(DISTINCT surface) AS vocabulary FROM q UNION ALL SELECT 'lowercased', count(*), count(DISTINCT low) FROM q UNION ALL SELECT 'stopwords_removed', count(*), count(DISTINCT low) FROM q WHERE norm NOT IN {NLTK} UNION ALL SELECT 'normalized', count(*), count(DISTINCT norm) FROM q UNION ALL SELECT 'index_terms', count(*), count(DISTINCT norm) FROM q WHERE is_word AND norm NOT IN {NLTK}")
def stage_counts(spark, sf):
    return P.stage_counts(toks(spark, sf, STEMMED))


@query(STOPPED_SQL + """, e AS (SELECT term, doc_id // 65536 AS block, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM p GROUP BY ALL)
SELECT term, block, '{"df":' || count(*) || ',"cf":' || sum(tf)::BIGINT || ',"postings":[' || string_agg('{"doc_id":' || doc_id || ',"positions":[' || places || ']}', ',' ORDER BY doc_id) || ']}' AS json FROM e GROUP BY term, block""")
def index_export(spark, sf):
    from ..sources.sinks import index_json

    return index_json(index(spark, sf, STOPPED))


# ------------------------------------------------------------------ retrieval
def _unit_sql(terms: list[tuple[str, int]]) -> str:
    first, *rest = terms
    joins = " ".join(f"JOIN p AS x{i} ON x{i}.doc_id = x.doc_id AND x{i}.term = '{t}' AND x{i}.pos = x.pos + {o - first[1]}" for i, (t, o) in enumerate(rest))
    return f"(SELECT x.doc_id FROM p AS x {joins} WHERE x.term = '{first[0]}')"


def _search_sql(test: str, weights: dict[str, int], prefix: str = POST) -> str:
    """``test`` holds {unit} texts already written out; weights: terms of units that are not negated."""
    w = "CASE term " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in weights.items()) + " END"
    return prefix + _TFIDF + f", s AS (SELECT doc_id, sum({w} * w) AS s FROM w WHERE term IN {_in(weights)} GROUP BY doc_id) SELECT d.doc_id, round(coalesce(s, 0.0), 4) AS score FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id) WHERE {test}"


def _has(*terms: str) -> str:
    return "d.doc_id IN " + _unit_sql([(t, i) for i, t in enumerate(terms)])


def _search(spark, sf, q: str, mode: str = "auto", p: P.Pipeline = PLAIN) -> DataFrame:
    return Engine(index(spark, sf, p)).search(q, mode)


@query(_search_sql(f"{_has('the')} AND {_has('licensed')}", {"the": 1, "licensed": 1}))
def search_keyword(spark, sf):
    return _search(spark, sf, "the licensed", "keyword")


@query(_search_sql(_has("of", "the"), {"of": 1, "the": 1}))
def search_phrase(spark, sf):
    return _search(spark, sf, '"of the"', "phrase")


@query(_search_sql("d.doc_id IN " + _unit_sql([("eaea", 0), ("thin", 2)]), {"eaea": 1, "thin": 1}, STOPPED_SQL))
def search_phrase_gap(spark, sf):
    """A stop word in a phrase leaves a gap that any word fills."""
    return _search(spark, sf, '"eaea the thin"', "auto", STOPPED)


@query(_search_sql(f"{_has('rights', 'reserved')} AND {_has('the')}", {"rights": 1, "reserved": 1, "the": 1}))
def search_and(spark, sf):
    return _search(spark, sf, "rights reserved AND the")


@query(_search_sql(f"{_has('idiot')} OR {_has('licensed', 'under')}", {"idiot": 1, "licensed": 1, "under": 1}))
def search_or(spark, sf):
    return _search(spark, sf, "idiot OR licensed under")


@query(_search_sql(f"{_has('of')} AND NOT {_has('to')}", {"of": 1}))
def search_not(spark, sf):
    return _search(spark, sf, "of AND NOT to")


@query(_search_sql(f"({_has('de')} OR {_has('und')}) AND NOT ({_has('la')} AND {_has('of', 'the')})", {"de": 1, "und": 1}))
def search_nested(spark, sf):
    return _search(spark, sf, '(de OR und) AND NOT (la AND "of the")')


@query(_search_sql(_has("that"), {"that": 1}) + " ORDER BY score DESC, doc_id LIMIT 10")
def rank_tfidf(spark, sf):
    """Flagship: documents to lines, tokens, positions, postings, TF-IDF and the ten best."""
    return Engine(index(spark, sf)).search("that", limit=10)


@query("SELECT doc_id, regexp_extract(text, '(?i)licensed under', 0) AS hit FROM documents WHERE regexp_matches(text, '(?i)\\blicensed under\\b')")
def snippet_hit(spark, sf):
    return docs(spark, sf).select("doc_id", snippet(F.col("text"), ["licensed under"]).alias("s")).filter("s is not null").select("doc_id", "s.hit")


TERMS = ["licensed", "all rights reserved", "the of", "mit license"]


@query(POST + ", truth AS (" + " UNION ALL ".join(f"SELECT '{t}' AS key, doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')" for t in TERMS) + "), found AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS key, doc_id FROM {_unit_sql([(w, i) for i, w in enumerate(t.split())])}" for t in TERMS) + "), b AS (SELECT coalesce(t.key, f.key) AS key, t.doc_id AS t, f.doc_id AS f FROM truth t FULL JOIN found f ON t.key = f.key AND t.doc_id = f.doc_id) SELECT key, count(t) AS truth, count(f) AS found, round(count(*) FILTER (t IS NOT NULL AND f IS NOT NULL) / count(*), 4) AS jaccard, count(*) FILTER (t IS NOT NULL AND f IS NOT NULL) = count(*) AS preserved FROM b GROUP BY key")
def fidelity_jaccard(spark, sf):
    """Domain terms: documents by pattern against documents by phrase search."""
    d, ix = docs(spark, sf), index(spark, sf)
    truth = found = None
    for t in TERMS:
        a = d.filter(F.lower("text").rlike(rf"(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])")).select(F.lit(t).alias("key"), "doc_id")
        b = ix.phrase_docs([(w, i) for i, w in enumerate(t.split())]).select(F.lit(t).alias("key"), "doc_id")
        truth, found = (a, b) if truth is None else (truth.union(a), found.union(b))
    return fidelity(truth, found)


# ------------------------------------------------------------------ n-grams
_SENT = ", s AS (SELECT doc_id, sent_no, list(low ORDER BY tok_no) AS toks FROM tok GROUP BY doc_id, sent_no)"
_GRAMS = "SELECT unnest(list_transform(range(1, len(toks) - {n} + 2), lambda i: array_to_string(toks[i : i + {n} - 1], ' '))) AS ngram FROM s WHERE len(toks) >= {n}"


def _streams(spark, sf, p: P.Pipeline = PLAIN) -> DataFrame:
    return P.sentence_streams(toks(spark, sf, p))


def _ngram(n: int):
    def run(spark, sf):
        return ngrams.ngrams(_streams(spark, sf), n).select(F.array_join("gram", " ").alias("ngram"), "count")

    run.__name__ = f"ngram_{n}"
    query(TOK + _SENT + ", g AS (" + _GRAMS.format(n=n) + ') SELECT ngram, count(*) AS "count" FROM g GROUP BY ngram')(run)


for _n in range(1, 6):
    _ngram(_n)

_EDGES = f"regexp_matches(split_part(ngram, ' ', 1), '[\\p{{L}}\\p{{N}}]') AND regexp_matches(split_part(ngram, ' ', 2), '[\\p{{L}}\\p{{N}}]') AND split_part(ngram, ' ', 1) NOT IN {NLTK} AND split_part(ngram, ' ', 2) NOT IN {NLTK}"
_SENT_M = _SENT.replace("s AS (", "s AS MATERIALIZED (")
_BIGRAMS = TOK + _SENT_M + ", g AS (" + _GRAMS.format(n=2) + "), c AS MATERIALIZED (SELECT ngram, count(*) AS n FROM g GROUP BY ngram)"


@query(_BIGRAMS + f' SELECT ngram, n AS "count" FROM c WHERE {_EDGES}')
def edge_filter(spark, sf):
    return ngrams.clean_edges(ngrams.ngrams(_streams(spark, sf), 2), N.stopwords("nltk")).select(F.array_join("gram", " ").alias("ngram"), "count")


@query(_BIGRAMS + ' SELECT sum(n)::BIGINT AS total, count(*) AS "unique", count(*) FILTER (n = 1) AS singletons, round(count(*) FILTER (n = 1) / count(*), 4) AS singleton_share FROM c')
def ngram_summary(spark, sf):
    return ngrams.summary(ngrams.ngrams(_streams(spark, sf), 2))


@query(_BIGRAMS + ' SELECT ngram, n AS "count" FROM c ORDER BY n DESC, ngram LIMIT 50')
def ngram_top50(spark, sf):
    return ngrams.top(ngrams.ngrams(_streams(spark, sf), 2), 50)


@query(_BIGRAMS + f", a AS (SELECT doc_id, sent_no, list(low ORDER BY tok_no) AS toks FROM tok WHERE is_word AND low NOT IN {NLTK} GROUP BY doc_id, sent_no), h AS (" + _GRAMS.format(n=2).replace("FROM s", "FROM a") + ') SELECT ngram, count(*) AS "count" FROM h WHERE ngram NOT IN (SELECT ngram FROM c) GROUP BY ngram')
def invented_ngrams(spark, sf):
    before = ngrams.ngrams(_streams(spark, sf), 2)
    kept = P.sentence_streams(toks(spark, sf, STOPPED).filter("term is not null"))
    return ngrams.invented(ngrams.ngrams(kept, 2), before).select(F.array_join("gram", " ").alias("ngram"), "count")


_VARIANTS = TOK + f", s AS MATERIALIZED (SELECT doc_id, sent_no, list(low ORDER BY tok_no) AS toks FROM tok WHERE is_word GROUP BY doc_id, sent_no), a AS MATERIALIZED (SELECT doc_id, sent_no, list(low ORDER BY tok_no) AS toks FROM tok WHERE is_word AND low NOT IN {NLTK} GROUP BY doc_id, sent_no)"
for _n in (1, 2, 3):
    _ends = f"split_part(ngram, ' ', 1) NOT IN {NLTK} AND split_part(ngram, ' ', {_n}) NOT IN {NLTK}"
    for _t in ("s", "a"):
        _VARIANTS += f", {_t}{_n} AS MATERIALIZED (SELECT ngram, count(*) AS c FROM ({_GRAMS.format(n=_n).replace('FROM s', f'FROM {_t}')}) GROUP BY ngram)"
    _VARIANTS += f", e{_n} AS (SELECT * FROM s{_n} WHERE {_ends})"
_VARIANTS += ", v AS (" + " UNION ALL ".join(f"SELECT {n} AS n, '{name}' AS variant, ngram, c FROM {t}{n}" for n in (1, 2, 3) for t, name in (("s", "all"), ("e", "meaningful_filter"), ("a", "after_stopword_removal"))) + ")"


@query(_VARIANTS + ', z AS (SELECT *, row_number() OVER (PARTITION BY n, variant ORDER BY c DESC, ngram) AS rank, sum(c) OVER (PARTITION BY n, variant)::BIGINT AS total, count(*) OVER (PARTITION BY n, variant) AS u FROM v) SELECT n::BIGINT AS n, variant, rank, ngram, c AS "count", round(c / total, 6) AS frequency, total, u AS "unique" FROM z WHERE rank <= 10')
def ngram_variants(spark, sf):
    """The commonest n-grams of words: all, with clean edges, and after stop words are removed."""
    return ngrams.variant_tops(ngrams.variants(P.native_streams(docs(spark, sf), PLAIN), N.stopwords("nltk")))


@query(_BIGRAMS + f""", m AS (SELECT list_append(toks, '</s>') AS toks FROM s), u AS MATERIALIZED (SELECT w, count(*)::DOUBLE AS c FROM (SELECT unnest(toks) AS w FROM m) GROUP BY w), t AS (SELECT sum(c) AS nn FROM u),
x AS (SELECT ngram, n::DOUBLE AS k, a.c AS ca, b.c AS cb, nn FROM c JOIN u a ON a.w = split_part(ngram, ' ', 1) JOIN u b ON b.w = split_part(ngram, ' ', 2), t WHERE n >= 3 AND {_EDGES})
SELECT ngram, k::BIGINT AS "count", round(2 * (k * ln(k / (ca * cb / nn)) + CASE WHEN ca > k THEN (ca - k) * ln((ca - k) / (ca * (nn - cb) / nn)) ELSE 0 END + CASE WHEN cb > k THEN (cb - k) * ln((cb - k) / ((nn - ca) * cb / nn)) ELSE 0 END + (nn - ca - cb + k) * ln((nn - ca - cb + k) / ((nn - ca) * (nn - cb) / nn))), 2) AS log_likelihood, round(log2(k * nn / (ca * cb)), 3) AS pmi FROM x""")
def collocation_2(spark, sf):
    return ngrams.collocations(_streams(spark, sf), N.stopwords("nltk"), 2)


_CELLS = [((1, 1, 1), "k"), ((1, 1, 0), "p01 - k"), ((1, 0, 1), "p02 - k"), ((0, 1, 1), "p12 - k"), ((1, 0, 0), "c0 - p01 - p02 + k"), ((0, 1, 0), "c1 - p01 - p12 + k"), ((0, 0, 1), "c2 - p02 - p12 + k"), ((0, 0, 0), "nn - c0 - c1 - c2 + p01 + p02 + p12 - k")]
_G3 = " + ".join(f"CASE WHEN {o} > 0 THEN 2 * ({o}) * ln(({o}) / ({' * '.join(f'c{i}' if x else f'(nn - c{i})' for i, x in enumerate(cell))} / nn / nn)) ELSE 0 END" for cell, o in _CELLS)
_WORD3 = " AND ".join(f"regexp_matches(w{i}, '[\\p{{L}}\\p{{N}}]')" for i in range(3))


@query(TOK + _SENT_M + ", g AS (" + _GRAMS.format(n=3) + f"""), c AS MATERIALIZED (SELECT split_part(ngram, ' ', 1) AS w0, split_part(ngram, ' ', 2) AS w1, split_part(ngram, ' ', 3) AS w2, ngram, count(*) AS n FROM g GROUP BY ngram HAVING count(*) >= 3),
m AS MATERIALIZED (SELECT list_append(toks, '</s>') AS toks FROM s), u AS MATERIALIZED (SELECT w, count(*)::DOUBLE AS c FROM (SELECT unnest(toks) AS w FROM m) GROUP BY w), t AS (SELECT sum(c) AS nn FROM u),
b2 AS MATERIALIZED (SELECT x.a AS a, x.b AS b, count(*)::DOUBLE AS p FROM (SELECT unnest(list_transform(range(1, len(toks)), lambda i: {{'a': toks[i], 'b': toks[i + 1]}})) AS x FROM m) GROUP BY ALL),
sk AS MATERIALIZED (SELECT x.a AS a, x.b AS b, count(*)::DOUBLE AS p FROM (SELECT unnest(list_transform(range(1, len(toks) - 1), lambda i: {{'a': toks[i], 'b': toks[i + 2]}})) AS x FROM m WHERE len(toks) >= 3) GROUP BY ALL),
j AS (SELECT ngram, n::DOUBLE AS k, u0.c AS c0, u1.c AS c1, u2.c AS c2, coalesce(x.p, 0) AS p01, coalesce(y.p, 0) AS p12, coalesce(z.p, 0) AS p02, nn FROM c JOIN u u0 ON u0.w = w0 JOIN u u1 ON u1.w = w1 JOIN u u2 ON u2.w = w2 LEFT JOIN b2 x ON x.a = w0 AND x.b = w1 LEFT JOIN b2 y ON y.a = w1 AND y.b = w2 LEFT JOIN sk z ON z.a = w0 AND z.b = w2, t WHERE {_WORD3} AND w0 NOT IN {NLTK} AND w2 NOT IN {NLTK})
SELECT ngram, k::BIGINT AS "count", round({_G3}, 2) AS log_likelihood, round(log2(k / (c0 * c1 / nn * c2 / nn)), 3) AS pmi FROM j""")
def collocation_3(spark, sf):
    return ngrams.collocations(_streams(spark, sf), N.stopwords("nltk"), 3)


@query(_BIGRAMS + ", e AS (SELECT split_part(ngram, ' ', 1) AS a, split_part(ngram, ' ', 2) AS b, n FROM c ORDER BY n DESC, a, b LIMIT 60) SELECT id, sum(n)::BIGINT AS weight FROM (SELECT a AS id, n FROM e UNION ALL SELECT b, n FROM e) GROUP BY id")
def network_degree(spark, sf):
    return ngrams.network(ngrams.ngrams(_streams(spark, sf), 2))[0]


# ------------------------------------------------------------------ statistics
_STATS = ", v AS (SELECT doc_id, low, count(*) AS c FROM tok WHERE is_word GROUP BY ALL), vv AS (SELECT doc_id, count(*) AS vocabulary, sum(c)::BIGINT AS word_tokens, count(*) FILTER (c = 1) AS hapax FROM v GROUP BY doc_id), tt AS (SELECT doc_id, count(*) AS tokens, max(sent_no) + 1 AS sentences FROM tok GROUP BY doc_id), ds AS (SELECT d.doc_id, coalesce(sentences, 0) AS sentences, coalesce(tokens, 0) AS tokens, coalesce(word_tokens, 0) AS word_tokens, length(text) AS characters, coalesce(vocabulary, 0) AS vocabulary, round(coalesce(vocabulary, 0) / greatest(1, coalesce(word_tokens, 0)), 4) AS type_token_ratio, coalesce(hapax, 0) AS hapax FROM documents d LEFT JOIN tt USING (doc_id) LEFT JOIN vv USING (doc_id))"


@query(TOK + _STATS + " SELECT * FROM ds")
def doc_stats(spark, sf):
    return stats.doc_stats(docs(spark, sf), toks(spark, sf))


@query(TOK + _STATS + " SELECT count(*) AS documents, sum(sentences)::BIGINT AS sentences, sum(tokens)::BIGINT AS tokens, sum(word_tokens)::BIGINT AS word_tokens, sum(characters)::BIGINT AS characters, round(sum(tokens)::DOUBLE / count(*), 1) AS avg_tokens, round(sum(characters)::DOUBLE / count(*), 1) AS avg_characters FROM ds")
def corpus_summary(spark, sf):
    return stats.corpus_summary(stats.doc_stats(docs(spark, sf), toks(spark, sf)))


@query(TOK + _STATS + ", b AS (SELECT lang, sum(tokens)::DOUBLE AS tokens, sum(characters)::DOUBLE AS characters, count(*) AS n FROM ds JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())) SELECT coalesce(lang, 'TOTAL') AS label, tokens, b.characters FROM b UNION ALL SELECT 'AVERAGE', round(tokens / n, 1), round(b.characters / n, 1) FROM b WHERE lang IS NULL")
def corpus_rollup(spark, sf):
    s = stats.doc_stats(docs(spark, sf), toks(spark, sf)).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return stats.with_totals(s, "lang", ["tokens", "characters"])


_VOCAB = ", vc AS (SELECT low AS term, count(*) AS n FROM tok WHERE is_word GROUP BY low), rk AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS r FROM vc)"


def _vocab(spark, sf) -> DataFrame:
    return toks(spark, sf).filter("is_word").groupBy(F.lower("surface").alias("term")).agg(F.count("*").alias("count"))


@query(TOK + _VOCAB + " SELECT count(*) AS types, round(regr_slope(log10(n), log10(r)), 3) AS slope FROM rk")
def zipf_slope(spark, sf):
    return stats.zipf(_vocab(spark, sf))


@query(TOK + _VOCAB + ", z AS (SELECT max(r) AS n FROM rk), mk AS (SELECT DISTINCT greatest(1, round(pow(10.0, k * log10(n) / 400)))::BIGINT AS r FROM z, range(0, 401) AS g(k)) SELECT r AS rank, term, n AS \"count\" FROM rk JOIN mk USING (r)")
def zipf_points(spark, sf):
    return stats.zipf_points(_vocab(spark, sf))


_HEAPS = ", o AS (SELECT low, row_number() OVER (ORDER BY doc_id, pos) AS i FROM tok), fi AS (SELECT min(i) AS born FROM o GROUP BY low), z AS (SELECT count(*) AS n FROM o), mk AS (SELECT DISTINCT greatest(1, floor(n * k / 60.0))::BIGINT AS tokens FROM z, range(1, 61) AS g(k)), pt AS (SELECT tokens, count(*) AS vocabulary FROM mk JOIN fi ON born <= tokens GROUP BY tokens)"


@query(TOK + _HEAPS + " SELECT tokens, vocabulary FROM pt")
def heaps_points(spark, sf):
    return stats.heaps_points(toks(spark, sf))


@query(TOK + _HEAPS + " SELECT round(exp(regr_intercept(ln(vocabulary), ln(tokens))), 2) AS K, round(regr_slope(ln(vocabulary), ln(tokens)), 3) AS beta FROM pt")
def heaps_fit(spark, sf):
    return stats.power_fit(stats.heaps_points(toks(spark, sf)), "tokens", "vocabulary")


@query(TOK + ", l AS (SELECT (least(count(*), 80) // 5) * 5 AS bin FROM tok GROUP BY doc_id, sent_no) SELECT g.bin, count(l.bin) AS n FROM range(0, 81, 5) AS g(bin) LEFT JOIN l ON l.bin = g.bin GROUP BY g.bin")
def sent_len_hist(spark, sf):
    return stats.histogram(toks(spark, sf).groupBy("doc_id", "sent_no").agg(F.count("*").alias("n")), "n")


@query(TOK + ", w AS (SELECT lag(surface) OVER q AS a, surface AS b, lead(surface) OVER q AS c FROM tok WINDOW q AS (PARTITION BY doc_id ORDER BY pos)), f AS (SELECT * FROM w WHERE a IS NOT NULL AND c IS NOT NULL) SELECT 'hyphenated word split' AS problem, count(*) FILTER (b = '-' AND regexp_full_match(a, '\\p{L}+') AND regexp_full_match(c, '\\p{L}+')) AS occurrences FROM f UNION ALL SELECT 'currency symbol split', count(*) FILTER (b IN ('$', '₹', '€', '£') AND regexp_matches(c, '^[0-9]')) FROM f UNION ALL SELECT 'percent split', count(*) FILTER (b = '%' AND regexp_matches(a, '^[0-9]')) FROM f UNION ALL SELECT 'fraction split', count(*) FILTER (b = '/' AND regexp_full_match(a, '[0-9]+') AND regexp_full_match(c, '[0-9]+')) FROM f")
def audit_lag_lead(spark, sf):
    a = stats.audit(toks(spark, sf))
    return a.filter(F.col("problem").isin("hyphenated word split", "currency symbol split", "percent split", "fraction split")).select("problem", "occurrences")


_AUDIT = """, w AS (SELECT doc_id, pos, lag(surface) OVER q AS a, surface AS b, lead(surface) OVER q AS c FROM tok WINDOW q AS (PARTITION BY doc_id ORDER BY pos)), f AS (SELECT * FROM w WHERE a IS NOT NULL AND c IS NOT NULL),
k AS (SELECT *, unnest([{'p': 'fraction split', 'h': b = '/' AND regexp_full_match(a, '[0-9]+') AND regexp_full_match(c, '[0-9]+')}, {'p': 'hyphenated word split', 'h': b = '-' AND regexp_full_match(a, '\\p{L}+') AND regexp_full_match(c, '\\p{L}+')},
 {'p': 'currency symbol split', 'h': b IN ('$', '₹', '€', '£') AND regexp_matches(c, '^[0-9]')}, {'p': 'percent split', 'h': b = '%' AND regexp_matches(a, '^[0-9]')}, {'p': 'abbreviation broken', 'h': b IN ('e.g', 'i.e', 'etc')},
 {'p': 'contraction split', 'h': replace(b, chr(39), '#') IN ('n#t', '#s', '#m', '#re', 'nt')}, {'p': 'operator split from expression', 'h': b IN ('+', '=') AND regexp_matches(a, '^[0-9]') AND regexp_matches(c, '^[0-9]')}]) AS x FROM f),
r AS (SELECT x.p AS problem, a || ' ' || b || ' ' || c AS t, doc_id, pos, row_number() OVER (PARTITION BY x.p ORDER BY doc_id, pos) AS n FROM k WHERE x.h), sh AS (SELECT problem, string_agg(t, ' | ' ORDER BY n) AS examples FROM r WHERE n <= 3 GROUP BY problem)
SELECT problem, occurrences, coalesce(examples, '') AS examples FROM (SELECT x.p AS problem, count(*) FILTER (x.h) AS occurrences FROM k GROUP BY x.p) LEFT JOIN sh USING (problem)"""


@query(TOK + _AUDIT)
def audit_examples(spark, sf):
    return stats.audit(toks(spark, sf))


@query("SELECT role, count(*) AS turns, sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')))::BIGINT AS words, round(avg(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))), 4) AS mean_words FROM conversations GROUP BY role")
def speaker_stats(spark, sf):
    n = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(n).alias("words"), F.round(F.avg(n), 4).alias("mean_words"))


@query("WITH s AS (SELECT role, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS toks FROM conversations), g AS (SELECT role, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS ngram FROM s WHERE len(toks) >= 2), c AS (SELECT role, ngram, count(*) AS n, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, ngram) AS r FROM g GROUP BY role, ngram) SELECT role, ngram, n AS \"count\" FROM c WHERE r <= 15")
def speaker_ngrams(spark, sf):
    """The 15 commonest bigrams of each role."""
    from pyspark.sql import Window

    t = table(spark, sf, "conversations").select("role", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("t")).filter(F.size("t") >= 2)
    g = t.select("role", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.slice("t", i, 2)))).alias("ngram")).groupBy("role", "ngram").agg(F.count("*").alias("count"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("count"), "ngram"))).filter("r <= 15").drop("r")


# ------------------------------------------------------------------ evaluation
@query("WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n) FILTER (a = b) AS s FROM c), e AS (SELECT sum(x * y) AS e FROM (SELECT a, sum(n) AS x FROM c GROUP BY a) l JOIN (SELECT b, sum(n) AS y FROM c GROUP BY b) r ON a = b) SELECT round((coalesce(s, 0) / t - e / (t * t)) / (1 - e / (t * t)), 4) AS kappa FROM t, e")
def kappa(spark, sf):
    return evaluate.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("SELECT g.gold, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM (SELECT unnest([0, 1])::BIGINT AS gold) g LEFT JOIN labels ON quality = g.gold GROUP BY g.gold")
def confusion_pivot(spark, sf):
    return evaluate.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c) SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM r")
def prf_labels(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return evaluate.prf(table(spark, sf, "labels").agg(F.count_if((q == 1) & (t == 1)).alias("tp"), F.count_if((q == 1) & (t == 0)).alias("fp"), F.count_if((q == 0) & (t == 1)).alias("fn")))


@query("SELECT count(*) AS tokens, count(*) FILTER (quality = toxic) AS correct, round(count(*) FILTER (quality = toxic) / count(*), 4) AS accuracy FROM labels")
def tagging_accuracy(spark, sf):
    return evaluate.tagging_accuracy(table(spark, sf, "labels"), "quality", "toxic")


@query('SELECT quality AS gold, toxic AS pred, count(*) AS "count" FROM labels WHERE quality <> toxic GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 15')
def tagging_errors(spark, sf):
    return evaluate.top_errors(table(spark, sf, "labels"), "quality", "toxic")


# Queries: one for each source; ranking: longest documents; relevant: labelled of good quality.
_RANKED = "rk AS (SELECT source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rl AS (SELECT source AS qid, doc_id, quality AS relevant FROM labels JOIN documents USING (doc_id))"


def _ranked(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select(F.col("source").alias("qid"), "doc_id", "n_chars")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n_chars"), "doc_id"))).drop("n_chars")
    return ranked, table(spark, sf, "labels").join(d, "doc_id").select("qid", "doc_id", F.col("quality").alias("relevant"))


@query("WITH " + _RANKED + """, rel AS (SELECT qid, doc_id FROM rl WHERE relevant = 1), nr AS (SELECT qid, count(*) AS relevant FROM rel GROUP BY qid), h AS (SELECT rk.qid, rank, (rel.doc_id IS NOT NULL)::BIGINT AS hit FROM rk LEFT JOIN rel ON rel.qid = rk.qid AND rel.doc_id = rk.doc_id), c AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS sf FROM h),
g AS (SELECT qid, count(*) AS retrieved, sum(hit)::BIGINT AS hits, sum(CASE WHEN hit = 1 THEN sf / rank ELSE 0 END) AS aps, sum(hit) FILTER (rank <= 3) AS h3, sum(hit) FILTER (rank <= 5) AS h5, sum(hit) FILTER (rank <= 10) AS h10 FROM c GROUP BY qid), a AS (SELECT g.*, coalesce(relevant, 0) AS relevant, hits / retrieved AS p, CASE WHEN coalesce(relevant, 0) = 0 THEN 1.0 ELSE hits / relevant END AS r FROM g LEFT JOIN nr USING (qid))
SELECT qid, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, retrieved, relevant, hits, round(h3 / 3, 4) AS p_at_3, round(CASE WHEN relevant = 0 THEN 1.0 ELSE h3 / relevant END, 4) AS r_at_3, round(h5 / 5, 4) AS p_at_5, round(CASE WHEN relevant = 0 THEN 1.0 ELSE h5 / relevant END, 4) AS r_at_5, round(h10 / 10, 4) AS p_at_10, round(CASE WHEN relevant = 0 THEN 1.0 ELSE h10 / relevant END, 4) AS r_at_10, round(CASE WHEN relevant = 0 THEN 1.0 ELSE aps / relevant END, 4) AS ap FROM a""")
def retrieval_metrics(spark, sf):
    return evaluate.retrieval_scores(*_ranked(spark, sf))


@query("WITH " + _RANKED + ", rel AS (SELECT qid, doc_id FROM rl WHERE relevant = 1), q AS (SELECT DISTINCT qid FROM rl), nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid), hh AS (SELECT qid, rank FROM rk SEMI JOIN rel USING (qid, doc_id)), g AS (SELECT q.qid, k, count(hh.rank) AS h FROM q CROSS JOIN range(1, 11) AS x(k) LEFT JOIN hh ON hh.qid = q.qid AND hh.rank <= k GROUP BY q.qid, k) SELECT k, round(sum(round(h / k * 10000)::BIGINT) / count(*) / 10000, 4) AS p, round(sum(round(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE h / n END * 10000)::BIGINT) / count(*) / 10000, 4) AS r FROM g LEFT JOIN nr USING (qid) GROUP BY k")
def curve_at_k(spark, sf):
    return evaluate.curve_at_k(*_ranked(spark, sf))


RUNS = [("A", 0.6432, 0.6533, 0.9632, 8549, False), ("B", 0.6791, 0.6933, 0.9736, 8931, False), ("H", 0.6346, 0.68, 0.9507, 9456, False), ("H2", 0.668, 0.6933, 0.982, 9454, True)]


@query(f"SELECT name, f1, p_at_5, fidelity, vocabulary FROM {_values(RUNS, 'name, f1, p_at_5, fidelity, vocabulary, posthoc')} WHERE NOT posthoc ORDER BY f1 DESC, p_at_5 DESC, fidelity DESC, vocabulary LIMIT 1")
def selection_rule(spark, sf):
    return evaluate.select_pipeline(_rows(spark, RUNS, "name string, f1 double, p_at_5 double, fidelity double, vocabulary long, posthoc boolean")).drop("posthoc")


_GOLD, _PRED = [("a", 0, 3), ("a", 4, 7), ("b", 0, 2)], [("a", 0, 3), ("a", 4, 6), ("b", 0, 2), ("b", 2, 3)]


@query("SELECT 2::BIGINT AS tp, 2::BIGINT AS fp, 1::BIGINT AS fn, 0.0 AS sentence_exact_match, 0.5 AS precision, 0.6667 AS recall, 0.5714 AS f1")
def boundary_scores(spark, sf):
    s = "id string, start int, end int"
    return evaluate.boundary_scores(_rows(spark, _GOLD, s), _rows(spark, _PRED, s))


_EG = [("s", 0, 0, 5, "X"), ("s", 1, 10, 15, "Y"), ("s", 2, 20, 25, "X")]
_EP = [("s", 0, 0, 5, "X"), ("s", 1, 11, 15, "Y"), ("s", 2, 40, 45, "Z")]


@query("SELECT 'ALL' AS label, 3::BIGINT AS gold, 3::BIGINT AS predicted, 1::BIGINT AS correct, 1::BIGINT AS incorrect, 1::BIGINT AS missed, 1::BIGINT AS spurious, 0.3333 AS precision, 0.3333 AS recall, 0.3333 AS f1")
def ner_overlap(spark, sf):
    s = "id string, ord int, start int, end int, label string"
    return evaluate.ner_scores(_rows(spark, _EG, s), _rows(spark, _EP, s)).filter("label = 'ALL'")


@query(f"SELECT id, start, \"end\", label, predicted_1, status_1, predicted_2, status_2 FROM {_values([('s', 0, 5, 'X', 'X', 'correct', None, 'missed'), ('s', 10, 15, 'Y', 'Y', 'incorrect', 'Y', 'correct'), ('s', 20, 25, 'X', None, 'missed', 'Z', 'incorrect')], 'id, start, \"end\", label, predicted_1, status_1, predicted_2, status_2')}")
def ner_comparison(spark, sf):
    s = "id string, ord int, start int, end int, label string"
    return evaluate.ner_comparison(_rows(spark, _EG, s), _rows(spark, _EP, s), _rows(spark, [("s", 0, 10, 15, "Y"), ("s", 1, 22, 26, "Z")], s))


@query("SELECT source, median(n_chars) AS median FROM documents GROUP BY source")
def median_length(spark, sf):
    return evaluate.median(table(spark, sf, "documents"), "n_chars", "source")


JUDGED = [f"Q{i:02d}" for i in range(1, 16)]


@query(f"SELECT d.doc_id, q.qid, coalesce((l.quality = 1 AND q.i % 2 = l.toxic)::BIGINT, 0) AS relevant FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN {_values([(q, i) for i, q in enumerate(JUDGED)], 'qid, i').replace('AS v(', 'AS q(')} LEFT JOIN labels l ON l.doc_id = d.doc_id")
def qrels_dense(spark, sf):
    """Judgements are kept sparse; the dense grid is that of a stated list of queries, zero where not judged."""
    judged = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.explode(F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(i % 2).alias("side")) for i, q in enumerate(JUDGED)])).alias("q"), "toxic")
    sparse = judged.filter("q.side = toxic").select("doc_id", "q.qid", F.lit(1).alias("relevant"))
    return evaluate.dense_qrels(docs(spark, sf).select("doc_id").distinct(), JUDGED, sparse)


@query("SELECT toxic, quality, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY toxic, quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM labels) WHERE r <= 3")
def judge_sample(spark, sf):
    """Three of each stratum by a hash of the id."""
    from pyspark.sql import Window

    w = Window.partitionBy("toxic", "quality").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return table(spark, sf, "labels").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("toxic", "quality", "doc_id")


@query("SELECT doc_id, 2 * len(regexp_extract_all(text, '(?i)licen[cs]e')) + len(regexp_extract_all(text, '(?i)rights')) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25")
def select_papers(spark, sf):
    """Documents by weighted pattern counts, the best 25."""
    s = 2 * F.regexp_count("text", F.lit("(?i)licen[cs]e")) + F.regexp_count("text", F.lit("(?i)rights"))
    return docs(spark, sf).select("doc_id", s.alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


# ------------------------------------------------------------------ evidence and entities
CLAIMS = [
    ("1/2+1/3=2/5", "M01 adds numerators and adds denominators"), ("1/2 + 1/3 = 5/6", "correct fraction addition"), ("1/2 + 1/3 = 1/6", "SLIP or other error in fraction addition"),
    ("1/8 is bigger than 1/6", "M02 larger denominator means larger fraction"), ("1/6 > 1/8", ""), ("2/3 is less than 1/2", "incorrect fraction comparison"), ("0.45 is bigger than 0.6", "M05 longer decimal is bigger"),
    ("0.3 x 0.2 = 0.6", "M06 decimals multiplied as whole numbers"), ("1/2 = 3/4", "M10 equivalent fractions by adding the same number"), ("I add the tops and then the bottoms", "M01 adds numerators and adds denominators"), ("1/0 + 1/2 = 2/2", ""),
]


@query(f"SELECT text, hypotheses FROM {_values(CLAIMS, 'text, hypotheses')}")
def detect_values(spark, sf):
    d = _rows(spark, CLAIMS, "text string, e string")
    return d.select("text", F.array_join(F.transform(evidence.detect(F.col("text")), lambda x: x["hypothesis"]), "; ").alias("hypotheses"))


CHECKS = [
    ("1/2+1/3=2/5", "2/5 = (1+1)/(2+3); correct sum is 5/6"), ("1/2 + 1/3 = 5/6", "1/2 + 1/3 = 5/6 (correct)"), ("1/2 + 1/2 = 4/4", "1/2 + 1/2 = 1 (correct)"), ("2/4 + 1/4 = 1/6", "correct sum is 3/4, not 1/6"),
    ("1/8 is bigger than 1/6", "1/8 < 1/6"), ("2/3 is less than 1/2", "2/3 > 1/2"), ("0.45 is bigger than 0.6", "0.45 < 0.6"), ("0.3 x 0.2 = 0.6", "0.3 x 0.2 = 0.06"), ("1/2 = 3/4", "1/2 = 0.500 but 3/4 = 0.750"), ("I add the tops and then the bottoms", "verbal description"),
]


@query(f"SELECT text, checks FROM {_values(CHECKS, 'text, checks')}")
def detect_checks(spark, sf):
    """The arithmetic that each finding rests on, written out."""
    d = _rows(spark, CHECKS, "text string, e string")
    return d.select("text", F.array_join(F.transform(evidence.detect(F.col("text")), lambda x: x["check"]), "; ").alias("checks"))


_CLAIMED = "SELECT l_linenumber AS a, (l_quantity::BIGINT % 9) + 2 AS b, l_suppkey::BIGINT % 5 + 1 AS c, l_partkey::BIGINT % 7 + 2 AS d FROM lineitem"


@query(f"""WITH x AS ({_CLAIMED}), y AS (SELECT *, a || '/' || b || ' + ' || c || '/' || d || ' = ' || (a + c) || '/' || (b + d) AS said, a || '/' || b || ' is bigger than ' || c || '/' || d AS compared, (a * d + c * b) * (b + d) = b * d * (a + c) AS correct FROM x)
SELECT CASE WHEN correct THEN 'correct fraction addition' ELSE 'M01 adds numerators and adds denominators' END AS hypothesis, count(*) AS n, count(DISTINCT said) AS spans FROM y GROUP BY 1
UNION ALL SELECT CASE WHEN a = c THEN 'M02 larger denominator means larger fraction' ELSE 'incorrect fraction comparison' END, count(*), count(DISTINCT compared) FROM y WHERE NOT a * d > c * b GROUP BY 1
UNION ALL SELECT 'M10 equivalent fractions by adding the same number', count(*), count(DISTINCT c || '/' || d || ' = ' || (a + c) || '/' || (b + d)) FROM y WHERE a = b AND c * (b + d) <> (a + c) * d""")
def detect_table(spark, sf):
    """Claims about fractions, put together from a table's numbers, judged and counted."""
    x = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("a"), (F.col("l_quantity").cast("long") % 9 + 2).alias("b"), (F.col("l_suppkey").cast("long") % 5 + 1).alias("c"), (F.col("l_partkey").cast("long") % 7 + 2).alias("d"))
    said = F.format_string("I think %d/%d + %d/%d = %d/%d because %d/%d is bigger than %d/%d.", "a", "b", "c", "d", F.col("a") + F.col("c"), F.col("b") + F.col("d"), "a", "b", "c", "d")
    found = x.select(F.explode(evidence.detect(said)).alias("x")).select("x.*")
    return found.groupBy("hypothesis").agg(F.count("*").alias("n"), F.countDistinct("span").alias("spans"))


@query()
def detect(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(evidence.detect(F.col("text"))).alias("x")).select("doc_id", "x.*")


def _tfidf_sql(src: str, key: str) -> str:
    return f"SELECT {key}, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {src})"


@query(f"""WITH it AS (SELECT item_id, term, count(*) AS tf FROM ({_tfidf_sql('benchmark', 'item_id')}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM it, n GROUP BY term, n),
iw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM it JOIN idf USING (term)), inn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM iw GROUP BY item_id),
dt AS (SELECT doc_id, term, count(*) AS tf FROM ({_tfidf_sql('documents', 'doc_id')}) GROUP BY ALL), dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM dt JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
s AS (SELECT doc_id, item_id, round(sum(dw.w / dn.norm * (iw.w / inn.norm)), 4) AS score FROM dw JOIN dn USING (doc_id) JOIN iw USING (term) JOIN inn USING (item_id) GROUP BY ALL)
SELECT doc_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0) WHERE rank <= 1 AND score >= 0.6""")
def ground_cosine(spark, sf):
    """The nearest benchmark item of each document that is close to one."""
    return evidence.ground(docs(spark, sf), table(spark, sf, "benchmark"), 1).filter("score >= 0.6")


@query(f"SELECT text, 'E_' || left(sha1(text), 10) AS evidence_id FROM {_values([('1/2+1/3=2/5',), ('add the tops',)], 'text')}")
def evidence_id(spark, sf):
    return _rows(spark, [("1/2+1/3=2/5",), ("add the tops",)], "text string").select("text", evidence.evidence_id(F.col("text")).alias("evidence_id"))


@query()
def evidence_records(spark, sf):
    """Findings and nearest benchmark items of every document."""
    found = evidence.evidence_records(docs(spark, sf), table(spark, sf, "benchmark"))
    return found.select("doc_id", "record.evidence_id", F.to_json("record.interpretation").alias("interpretation"))


LEXICON = [("mit license", "LICENCE"), ("general public license", "LICENCE"), ("right", "CONCEPT"), ("CC", "NAME")]


@query(TOK + ", s AS (SELECT doc_id, sent_no, list(surface ORDER BY tok_no) AS t FROM tok GROUP BY ALL), w AS (SELECT doc_id, sent_no, i - 1 AS tok_no, n, array_to_string(t[i : i + n - 1], ' ') AS seen FROM s, unnest(range(1, len(t) + 1)) AS a(i), unnest(range(1, 4)) AS b(n) WHERE i + n - 1 <= len(t)), pt AS (SELECT * FROM " + _values(entities.patterns(LEXICON), "phrase, label, exact") + ") SELECT doc_id, sent_no, tok_no, n, phrase, label FROM w JOIN pt ON (exact AND seen = phrase) OR (NOT exact AND lower(seen) = phrase)")
def gazetteer_match(spark, sf):
    pats = _rows(spark, entities.patterns(LEXICON), "phrase string, label string, exact boolean")
    return entities.gazetteer(toks(spark, sf), F.broadcast(pats), 3)


@query()
def entity_ruler(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(entities.entities(F.col("text"), LEXICON)).alias("e")).select("doc_id", "e.*")


TAGS = [("Simplify 3/4 x 1/2", "VB CD SYM CD"), ("the top number", "DT JJ NN"), ("one over four", "CD IN CD"), ("idk the LCD", "UH DT NN")]


@query(f"SELECT text, tags FROM {_values(TAGS, 'text, tags')}")
def rule_tags_values(spark, sf):
    d = _rows(spark, [(i, t) for i, (t, _) in enumerate(TAGS)], "doc_id long, text string")
    t = tagging.rule_tags(P.positioned(d, "whitespace")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_no", "tag"))), lambda x: x["tag"]), " ").alias("tags"))
    return d.join(t, "doc_id").select("text", "tags")


def _case(c: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN {_in(words)} THEN '{tag}'" for tag, words in table.items()) + " END"


_NUM = tagging.NUMBER.replace("'", "''")
_TAGGED = TOK + f""", b AS (SELECT *, coalesce({_case('low', tagging.CLOSED)}, CASE WHEN regexp_matches(surface, '^-?[0-9]') THEN 'CD' WHEN surface IN ('.', '!', '?') THEN '.' WHEN surface IN (',', ';', ':', '(', ')') THEN ',' WHEN NOT is_word THEN 'SYM'
 WHEN low LIKE '%ing' AND length(surface) > 4 THEN 'VBG' WHEN low LIKE '%ed' AND length(surface) > 3 THEN 'VBD' WHEN low LIKE '%ly' THEN 'RB' WHEN regexp_matches(surface, '^[A-Z]') THEN 'NNP' WHEN low LIKE '%s' AND low NOT LIKE '%ss' AND length(surface) > 3 THEN 'NNS' ELSE 'NN' END) AS base,
 coalesce(lag(surface) OVER w, '') AS pv, coalesce(lead(surface) OVER w, '') AS nx, row_number() OVER w = 1 AS first FROM tok WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
k AS (SELECT *, {_case('low', tagging.DICTIONARY)} AS known FROM b),
y AS (SELECT *, CASE WHEN regexp_matches(surface, '{_NUM}') THEN ['CD', 'number/fraction pattern'] WHEN low IN {_in(tagging.OPERATORS)} AND regexp_matches(pv, '{_NUM}') AND regexp_matches(nx, '{_NUM}') THEN ['SYM', 'operator between numbers'] WHEN known IS NOT NULL THEN [known, 'domain dictionary']
 WHEN (first OR lower(pv) IN ('.', ':', ';', 'and', 'then', 'first')) AND low IN {_in(tagging.VERBS)} AND base <> 'VB' THEN ['VB', 'math instruction verb (imperative)'] WHEN low IN ('top', 'bottom') AND lower(nx) IN ('number', 'numbers', 'part', 'parts') THEN ['JJ', 'top/bottom as modifier']
 WHEN low = 'over' AND (regexp_matches(lower(pv), '{_NUM}') OR lower(pv) IN ('one', 'two', 'three', 'four')) THEN ['IN', chr(39) || 'over' || chr(39) || ' as fraction bar'] END AS r FROM k),
tg AS (SELECT doc_id, sent_no, tok_no, surface, low, base, CASE WHEN r IS NOT NULL AND r[1] <> base THEN r[1] ELSE base END AS tag, CASE WHEN r IS NOT NULL AND r[1] <> base THEN r[2] ELSE '' END AS rule FROM y)"""


@query(_TAGGED + " SELECT tag, rule, count(*) AS n FROM tg GROUP BY ALL")
def tag_distribution(spark, sf):
    return tagging.rule_tags(toks(spark, sf)).groupBy("tag", "rule").agg(F.count("*").alias("n"))


@query(_TAGGED.replace("FROM documents", f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -i, text FROM {_values([(i + 1, t) for i, (t, _) in enumerate(TAGS)], 'i, text')})", 1) + " SELECT low AS word, base, tag AS rules, rule, count(*) AS n FROM tg WHERE tag <> base GROUP BY ALL")
def tagger_disagreements(spark, sf):
    """The documents, and a few sentences in which rules apply."""
    d = docs(spark, sf).union(_rows(spark, [(-i - 1, t) for i, (t, _) in enumerate(TAGS)], "doc_id long, text string"))
    return tagging.disagreements(tagging.tag_all(P.tokens(d, PLAIN)))


EXPECTED = {"the": "DT", "of": "IN", "to": "TO", "rights": "NNS", "reserved": "VBN", "under": "IN", "over": "IN", "x": "SYM", "round": "VB"}


def _case_of(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{w}' THEN '{t}'" for w, t in EXPECTED.items()) + " END"


@query(_TAGGED + f", tx AS (SELECT low, {_case_of('low')} AS expected, count(*) AS occurrences FROM tg WHERE low IN {_in(EXPECTED)} GROUP BY low), " + ", ".join(
    f"{c}1 AS (SELECT low, {c} AS tag, count(*) AS n, {c} = {_case_of('low')} AS hit FROM tg WHERE low IN {_in(EXPECTED)} GROUP BY low, {c}), {c}2 AS (SELECT low, string_agg(tag || ':' || n, ', ' ORDER BY n DESC, tag) FILTER (r <= 4) AS tags, round(1 - coalesce(sum(n) FILTER (hit), 0) / sum(n), 3) AS wrong FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC, tag) AS r FROM {c}1) GROUP BY low)" for c in ("base", "tag")
) + " SELECT tx.low AS term, occurrences, expected, base2.tags AS base_tags, base2.wrong AS base_wrong_share, tag2.tags AS rules_tags, tag2.wrong AS rules_wrong_share FROM tx JOIN base2 USING (low) JOIN tag2 USING (low)")
def domain_terms(spark, sf):
    return tagging.domain_terms(tagging.tag_all(toks(spark, sf)), EXPECTED)


LEMMA_GOLD = [("fractions", "fraction"), ("added", "add"), ("is", "be"), ("halves", "half"), ("running", "run"), ("3/4", "3/4"), ("adds", "add"), ("adds", "add"), ("children", "child")]


@query(f"SELECT lemmatizer, tokens, correct, accuracy, errors FROM {_values([('as is', 8, 0, 0.0, 'adds->adds (gold add); added->added (gold add); children->children (gold child); fractions->fractions (gold fraction); halves->halves (gold half); is->is (gold be); running->running (gold run)'), ('noun', 8, 5, 0.625, 'added->added (gold add); is->is (gold be); running->running (gold run)'), ('context-free', 8, 7, 0.875, 'halves->halve (gold half)')], 'lemmatizer, tokens, correct, accuracy, errors')}")
def lemma_accuracy(spark, sf):
    gold = _rows(spark, LEMMA_GOLD, "token string, lemma string")
    return evaluate.lemma_accuracy(gold, {"as is": lambda c: c, "noun": N.lemma_noun, "context-free": N.lemma_cf})


@query(f"SELECT w, shape FROM {_values([('ASSIST2009', 'XXdd'), ('GPT-4o', 'XX-dx'), ('word', 'xx')], 'w, shape')}")
def shape_values(spark, sf):
    return _rows(spark, [("ASSIST2009",), ("GPT-4o",), ("word",)], "w string").select("w", tagging.shape(F.col("w")).alias("shape"))


@query()
def noun_phrases(spark, sf):
    return tagging.noun_phrases(tagging.rule_tags(toks(spark, sf))).groupBy("phrase").agg(F.count("*").alias("n"))


@query()
def verb_objects(spark, sf):
    return tagging.verb_object_pairs(tagging.rule_tags(toks(spark, sf))).groupBy("verb", "object").agg(F.count("*").alias("n"))


@query()
def hmm_tags(spark, sf):
    """A sequence model trained on a bounded sample of rule-tagged sentences, on the tokens of all."""
    d = docs(spark, sf)
    return _tag_counts(d, tagging.HmmTagger(tagging.tagged_sample(d, PLAIN)))


@query(f"SELECT text, tags FROM {_values([('to run the run', 'TO VB DT NN'), ('adding 3/4', 'VBG CD')], 'text, tags')}")
def backoff_values(spark, sf):
    """The back-off chain on gold-like sentences."""
    model = tagging.BackoffTagger([[("the", "DT"), ("run", "NN")], [("to", "TO"), ("run", "VB")], [("add", "VB"), ("the", "DT"), ("tops", "NNS")]])
    d = _rows(spark, [("to run the run",), ("adding 3/4",)], "text string")
    return d.select("text", F.array_join(model.column(K.whitespace(F.col("text"))), " ").alias("tags"))


def _tag_counts(d, model) -> DataFrame:
    s = d.select(F.explode(K.split_sentences(F.col("text"), PLAIN.sentences)).alias("s"))
    return s.select(F.explode(model.column(K.tokenize(F.col("s"), PLAIN.tokenizer))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query()
def backoff_tags(spark, sf):
    """The back-off chain trained on a bounded sample of rule-tagged sentences, on the tokens of all."""
    d = docs(spark, sf)
    return _tag_counts(d, tagging.BackoffTagger(tagging.tagged_sample(d, PLAIN)))


@query(TOK + """, q AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(surface, '\\p{Lu}', 'X', 'g'), '\\p{Ll}', 'x', 'g'), '[0-9]', 'd', 'g'), 'XX+', 'XX', 'g') AS s FROM tok) SELECT regexp_replace(regexp_replace(s, 'xx+', 'xx', 'g'), 'dd+', 'dd', 'g') AS shape, count(*) AS n FROM q GROUP BY ALL""")
def word_features(spark, sf):
    return tagging.word_features(toks(spark, sf)).groupBy("shape").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ experiments
@query(TOK + f", q AS (SELECT *, {_STEM} AS norm FROM tok) SELECT 'tokens' AS measure, count(*) AS before, count(*) FILTER (is_word AND norm NOT IN {NLTK}) AS after FROM q UNION ALL SELECT 'vocabulary', count(DISTINCT surface), count(DISTINCT norm) FILTER (is_word AND norm NOT IN {NLTK}) FROM q")
def before_after(spark, sf):
    return experiments.before_after(toks(spark, sf, STEMMED))


@query(TOK + f", q AS (SELECT *, {_STEM} AS norm FROM tok), c AS (SELECT 'before' AS side, low AS term, count(*) AS n FROM q WHERE is_word GROUP BY low UNION ALL SELECT 'after', norm, count(*) FROM q WHERE is_word AND norm NOT IN {NLTK} GROUP BY norm) SELECT side, rank, term, n AS \"count\" FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 40")
def top_terms(spark, sf):
    return experiments.top_terms(toks(spark, sf, STEMMED))


@query(STOPPED_SQL + ", x AS (SELECT lang AS collection, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))))::BIGINT AS sentences, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))))::BIGINT AS tokens_whitespace FROM documents GROUP BY lang), t AS (SELECT lang AS collection, count(*) AS index_terms FROM p JOIN documents USING (doc_id) GROUP BY lang) SELECT x.*, coalesce(index_terms, 0) AS index_terms FROM x LEFT JOIN t ON x.collection IS NOT DISTINCT FROM t.collection")
def scale_summary(spark, sf):
    return experiments.scale_summary(table(spark, sf, "documents"), "lang", STOPPED)


_GOLD_TOKENS = [("t1", "I ate 3/4 of it", ["I", "ate", "3/4", "of", "it"]), ("t2", "paid $3,650 on 2026-09-01", ["paid", "$3,650", "on", "2026-09-01"])]


@query(f"SELECT removed, f1 FROM {_values([('none', 1.0), ('fraction', 0.8), ('percent', 1.0)], 'removed, f1')}")
def rule_ablation(spark, sf):
    gold = _rows(spark, _GOLD_TOKENS, "id string, text string, tokens array<string>")
    return experiments.rule_ablation(gold).filter("removed in ('none', 'fraction', 'percent')").select("removed", "f1")


@query(f"SELECT rule, found, whole, share FROM {_values([('fraction', 1, 0, 0.0), ('datetime', 1, 1, 1.0)], 'rule, found, whole, share')}")
def kept_whole(spark, sf):
    d = _rows(spark, [("a", "on 2026-09-01 it was (3/4)")], "id string, text string")
    return experiments.kept_whole(d, ["fraction", "datetime"], K.whitespace(F.col("text")))


@query(_BIGRAMS + f", j AS (SELECT ngram, (length(ngram) % 2)::BIGINT AS meaningful FROM c WHERE n >= 3), k AS (SELECT ngram FROM c WHERE {_EDGES} ORDER BY n DESC, ngram LIMIT 50) SELECT count(*) AS judged, round(coalesce(avg(meaningful), 0.0), 4) AS meaningful_share FROM k JOIN j USING (ngram)")
def meaningful_share(spark, sf):
    g = ngrams.ngrams(_streams(spark, sf), 2)
    judged = g.filter(F.col("count") >= 3).select(F.array_join("gram", " ").alias("ngram")).withColumn("meaningful", F.length("ngram") % 2)
    return experiments.meaningful_share(ngrams.top(ngrams.clean_edges(g, N.stopwords("nltk")), 50).select("ngram"), judged)


@query("WITH x AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)) SELECT source, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM x GROUP BY source")
def metric_means(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return experiments.metric_means(x, "source", ["quality", "toxic"])


@query()
def pipeline_comparison(spark, sf):
    """Named pipelines over the same queries, judged by labels of good quality."""
    d = docs(spark, sf)
    qrels = table(spark, sf, "labels").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("qid"), "doc_id", F.col("quality").alias("relevant"))
    return experiments.compare(d, list(P.PIPELINES), [(0, "licensed under"), (1, "rights AND NOT idiot")], qrels)


@query()
def pipeline_table(spark, sf):
    """The comparison with a row for each measure and a column for each of A, B and the selected pipeline."""
    d = docs(spark, sf)
    qrels = table(spark, sf, "labels").select(F.lit(0).alias("qid"), "doc_id", F.col("quality").alias("relevant"))
    return experiments.measures_by_pipeline(experiments.compare(d, ["A", "B", "C1"], [(0, "rights reserved")], qrels), ["A", "B"])


# ------------------------------------------------------------------ records to text
_WHO = "CASE WHEN role = 'assistant' THEN 'Teacher' WHEN role = 'user' THEN 'Student' ELSE role END"


@query(f"SELECT conv_id, md5(string_agg({_WHO} || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY turn, {_WHO} || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_md5 FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id")
def dialogue_to_text(spark, sf):
    who = F.when(F.col("role") == "assistant", "Teacher").when(F.col("role") == "user", "Student").otherwise(F.col("role"))
    t = L.turns_text(table(spark, sf, "conversations"), ["conv_id"], ["turn"], who, F.col("text"))
    return t.select("conv_id", F.md5("text").alias("text_md5"))


@query("SELECT event_id, props->>'$.k' AS k, len(json_keys(props)) AS n_keys FROM events")
def json_walk(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query(f"SELECT text, leaves FROM {_values([('{\"a\": \"x\", \"b\": 1, \"c\": \"y\"}', 'a: x' + chr(10) + 'c: y')], 'text, leaves')}")
def json_leaves_values(spark, sf):
    text = '{"a": "x", "b": 1, "c": "y"}'
    d = L.load_bytes(spark, [("x.json", text.encode())])
    return d.select(F.lit(text).alias("text"), F.col("text").alias("leaves"))


MATHML = [("<math><mfrac><mn>3</mn><mn>4</mn></mfrac></math>", "3/4"), ("<math><mn>2</mn><mfrac><mn>1</mn><mn>4</mn></mfrac></math>", "2 1/4"), ("<math><msup><mi>x</mi><mn>2</mn></msup></math>", "x^2"), ("<math><msqrt><mn>9</mn></msqrt></math>", "sqrt(9)")]


@query(f"SELECT xml, text FROM {_values(MATHML, 'xml, text')}")
def mathml(spark, sf):
    from xml.etree import ElementTree as ET

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: L.mathml_text(ET.fromstring(x)))

    return _rows(spark, [(x,) for x, _ in MATHML], "xml string").select("xml", run("xml").alias("text"))


MARKDOWN = [("# Title\n**bold** and [a](http://b)", "Title\nbold and a"), ("- one\n- two", "one\ntwo"), ("x `y` z", "x y z")]


@query(f"SELECT md, text FROM {_values(MARKDOWN, 'md, text')}")
def markdown_values(spark, sf):
    return _rows(spark, [(m,) for m, _ in MARKDOWN], "md string").select("md", L.markdown_text(F.col("md")).alias("text"))


LOADED = [('D01', 'TXT', 'D01_a', 'one\ntwo'), ('b', 'CSV', 'b', 'a: 1\nb: x\n\na: 2'), ('c', 'HTML', 'T', 'main'), ('d', 'JSONL', 'd', 'Problem: q\nConversation:\nA: hi\nB: yo'), ('e', 'XML', 'e', 'x y'), ('f', 'MD', 'H', 'H\ntext')]


@query(f"SELECT doc_id, fmt, title, text FROM {_values(LOADED, 'doc_id, fmt, title, text')}")
def load_formats(spark, sf):
    """Small files of several formats through the loaders."""
    files = [("D01_a.txt", b"one\ntwo"), ("b.csv", b"a,b\n1,x\n2,\n"), ("c.html", b"<html><title>T</title><nav>n</nav><p>main</p></html>"), ("d.jsonl", b'{"question": "q", "conversation": "A: (act) hi|EOM|B: yo"}'), ("e.xml", b"<r><a>x</a><b>y</b></r>"), ("f.md", b"# H\ntext")]
    return L.load_bytes(spark, files).select("doc_id", "fmt", "title", "text")


# ------------------------------------------------------------------ BPE
_BPE_WORDS = "w AS (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS word FROM documents) GROUP BY word)"


@query(f"WITH {_BPE_WORDS}, s AS (SELECT c, list_append(string_split(word, ''), '</w>') AS s FROM w), p AS (SELECT c, unnest(list_transform(range(1, len(s)), lambda i: {{'a': s[i], 'b': s[i + 1]}})) AS p FROM s) SELECT p.a AS a, p.b AS b, sum(c)::BIGINT AS \"count\" FROM p GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 1")
def bpe_top_pair(spark, sf):
    return bpe.top_pair(bpe.word_counts(docs(spark, sf)))


@query()
def bpe_train(spark, sf):
    m = bpe.train(docs(spark, sf), 300)
    return _rows(spark, [(i + 1, a, b) for i, (a, b) in enumerate(m.merges)], "step int, a string, b string")


@query()
def bpe_encode(spark, sf):
    m = bpe.train(docs(spark, sf), 300)
    return docs(spark, sf).select("doc_id", m.piece_counts(K.pretokenize(F.col("text"))).alias("pieces"))


def _words_sql(src: str) -> str:
    """Word-level tokens: separators kept, a double hyphen by a mark of its own."""
    return f"SELECT unnest(list_filter(list_transform(regexp_extract_all(replace(text, '--', chr(1)), '\\x01|[,.:;?_!\"()'']|[^,.:;?_!\"()''\\s\\x0b\\x01]+'), lambda x: CASE WHEN x = chr(1) THEN '--' ELSE trim(x) END), lambda x: x <> '')) AS token FROM {src}"


@query(f"WITH v AS (SELECT DISTINCT token FROM ({_words_sql('documents')})), n AS (SELECT count(*) AS n FROM v) SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM v UNION ALL SELECT '{bpe.END_OF_TEXT}', n FROM n UNION ALL SELECT '{bpe.UNKNOWN}', n + 1 FROM n")
def word_vocab(spark, sf):
    return bpe.vocabulary(docs(spark, sf))


@query(f"WITH v AS MATERIALIZED (SELECT DISTINCT token FROM ({_words_sql('documents')} WHERE lang <> 'de')), t AS (SELECT token FROM ({_words_sql('documents')} WHERE lang = 'de')) SELECT count(*) AS tokens, count(*) FILTER (v.token IS NULL) AS unknown, round(count(*) FILTER (v.token IS NULL) / greatest(1, count(*)), 4) AS oov_rate FROM t LEFT JOIN v USING (token)")
def word_vocab_oov(spark, sf):
    """Share of the tokens of German documents that the vocabulary of the others lacks."""
    d = table(spark, sf, "documents")
    return bpe.oov_rate(d.filter("lang = 'de'"), bpe.vocabulary(d.filter("lang <> 'de'")))


@query("WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS w FROM documents WHERE lang <> 'de'), t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS w FROM documents WHERE lang = 'de') SELECT count(*) AS tokens, count(*) FILTER (w NOT IN (SELECT w FROM v)) AS unknown, round(count(*) FILTER (w NOT IN (SELECT w FROM v)) / count(*), 4) AS oov_rate FROM t")
def dictionary_share(spark, sf):
    """Share of words that a lexicon lacks, by an anti join instead of a broadcast set."""
    d = table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    known = d.filter("lang <> 'de'").select("w").distinct().withColumn("k", F.lit(1))
    return d.filter("lang = 'de'").join(known, "w", "left").agg(F.count("*").alias("tokens"), F.count_if(F.col("k").isNull()).alias("unknown")).withColumn("oov_rate", F.round(F.col("unknown") / F.col("tokens"), 4))
