"""Part-of-speech tagging: base tags from a dictionary and shapes, domain rules over neighbours, a back-off chain.

Pretrained taggers are not available; ``base_tags`` is a plain substitute of our own.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokenizers as K
from .pipeline import Pipeline

# The number shape, domain dictionary, instruction verbs and closed classes.
NUMBER = r"^-?\d+(?:\s\d+)?/\d+$|^\d+(?:[.,]\d+)*%?$|^\d+(?:[./]\d+)*[-+×·*÷=][\d./+×·*÷=a-z-]+$"
OPERATORS = ["x", "×", "+", "=", "÷", "*"]
VERBS = "simplify find flip subtract multiply divide add write round plot shade convert cross solve compare estimate locate evaluate model translate rewrite draw name use order identify list graph reduce".split()
DOMAIN = {
    "lcd": "NN", "lcm": "NN", "gcf": "NN", "gcd": "NN",
    "bkt": "NNP", "dkt": "NNP", "sqkt": "NNP", "cikt": "NNP", "q-mckt": "NNP", "llmkt": "NNP",
    "mathdial": "NNP", "talkmoves": "NNP", "assistments": "NNP", "assist2009": "NNP", "ednet": "NNP",
    "mae": "NNP", "eedi": "NNP", "openstax": "NNP", "gpt-4": "NNP", "gpt-4o": "NNP", "chatgpt": "NNP",
    "halves": "NNS", "thirds": "NNS", "fourths": "NNS", "fifths": "NNS", "sixths": "NNS", "eighths": "NNS",
    "tenths": "NNS", "hundredths": "NNS", "quarters": "NNS",
    "numerator": "NN", "denominator": "NN", "numerators": "NNS", "denominators": "NNS",
    "reciprocal": "NN", "idk": "UH", "u": "PRP",
}
CLOSED = {
    "DT": "the a an this that these those each every some any no".split(), "IN": "of in on at by for with from into over under between as than because if while per".split(),
    "CC": "and or but nor".split(), "PRP": "i you he she it we they me him her us them".split(), "PRP$": "my your his its our their".split(),
    "MD": "can could will would shall should may might must".split(), "TO": ["to"], "VBZ": "is has does".split(), "VBP": "are have do am".split(), "VBD": "was were had did".split(),
    "WP": "who what".split(), "WDT": ["which"], "WRB": "how why where when".split(), "RB": "not very also too so then there here only".split(), "CD": "one two three four five six seven eight nine ten".split(),
}


#: Words of the domain by tag, for set lookups.
DICTIONARY = {tag: [w for w, t in DOMAIN.items() if t == tag] for tag in dict.fromkeys(DOMAIN.values())}


def _any(c: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(c.isin(words), tag) for tag, words in table.items()])


def base_tag(w: Column) -> Column:
    """Closed classes, then numbers, marks, capitals and suffixes; else a noun."""
    low = F.lower(w)
    shapes = F.when(w.rlike(r"^-?\d"), "CD").when(w.rlike(r"^[.!?]$"), ".").when(w.rlike(r"^[,;:()]$"), ",").when(~w.rlike(r"[\p{L}\p{N}]"), "SYM").when(low.rlike("ing$") & (F.length(w) > 4), "VBG").when(low.rlike("ed$") & (F.length(w) > 3), "VBD").when(low.rlike("ly$"), "RB").when(w.rlike("^[A-Z]"), "NNP").when(low.rlike("(?<!s)s$") & (F.length(w) > 3), "NNS").otherwise("NN")
    return F.coalesce(_any(low, CLOSED), shapes)


def rule_tags(tokens: DataFrame, base: str = "tag") -> DataFrame:
    """Adds tag and rule: the first of six rules that applies to (previous, current, next), else the base tag.

    Rules read the words and the base tags only, so one pass over each sentence is enough.
    """
    w = Window.partitionBy("doc_id", "sent_no").orderBy("tok_no")
    word, low = F.col("surface"), F.lower("surface")
    before, after = F.lower(F.coalesce(F.lag("surface").over(w), F.lit(""))), F.lower(F.coalesce(F.lead("surface").over(w), F.lit("")))
    t = tokens.withColumns({"_base": F.col(base) if base in tokens.columns else base_tag(word), "_low": low, "_before": before, "_after": after, "_raw_before": F.coalesce(F.lag("surface").over(w), F.lit("")), "_raw_after": F.coalesce(F.lead("surface").over(w), F.lit("")), "_first": F.row_number().over(w) == 1})
    c = F.col
    known = _any(c("_low"), DICTIONARY)
    rules = [
        (word.rlike(NUMBER), F.lit("CD"), "number/fraction pattern"),
        (c("_low").isin(OPERATORS) & c("_raw_before").rlike(NUMBER) & c("_raw_after").rlike(NUMBER), F.lit("SYM"), "operator between numbers"),
        (known.isNotNull(), known, "domain dictionary"),
        ((c("_first") | c("_before").isin(".", ":", ";", "and", "then", "first")) & c("_low").isin(VERBS) & (c("_base") != "VB"), F.lit("VB"), "math instruction verb (imperative)"),
        (c("_low").isin("top", "bottom") & c("_after").isin("number", "numbers", "part", "parts"), F.lit("JJ"), "top/bottom as modifier"),
        ((c("_low") == "over") & (c("_before").rlike(NUMBER) | c("_before").isin("one", "two", "three", "four")), F.lit("IN"), "'over' as fraction bar"),
    ]
    tag, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, value, name in reversed(rules):
        tag, why = F.when(test, value).otherwise(tag), F.when(test, F.lit(name)).otherwise(why)
    t = t.withColumns({"_tag": tag, "_why": why})
    changed = c("_tag").isNotNull() & (c("_tag") != c("_base"))
    return t.withColumns({"tag": F.when(changed, c("_tag")).otherwise(c("_base")), "rule": F.when(changed, c("_why")).otherwise("")}).drop("_base", "_low", "_before", "_after", "_raw_before", "_raw_after", "_first", "_tag", "_why")


def tag_all(tokens: DataFrame, taggers: dict | None = None) -> DataFrame:
    """The tokens with a column for each tagger: base, rules (and rule), and those given as functions of an array of a sentence's words."""
    plain = tokens.withColumn("base", base_tag(F.col("surface")))
    out = rule_tags(plain.withColumn("tag", F.col("base"))).withColumnRenamed("tag", "rules")
    for name, column in (taggers or {}).items():
        words = F.transform(F.sort_array(F.collect_list(F.struct("tok_no", "surface"))), lambda x: x["surface"])
        each = tokens.groupBy("doc_id", "sent_no").agg(column(words).alias("t")).select("doc_id", "sent_no", F.posexplode("t").alias("tok_no", name))
        out = out.join(each, ["doc_id", "sent_no", "tok_no"])
    return out


def disagreements(tagged: DataFrame) -> DataFrame:
    """(word, base, rules, rule, n): where the rules change the base tag, by word."""
    return tagged.filter("rules <> base").groupBy(F.lower("surface").alias("word"), "base", "rules", "rule").agg(F.count("*").alias("n"))


def domain_terms(tagged: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(term, occurrences, expected, base_tags, rules_tags, base_wrong_share, rules_wrong_share) of the stated words.

    The tags are the four commonest as ``tag:count``, ties by tag.
    """
    of = F.coalesce(*[F.when(F.col("word") == w, F.lit(t)) for w, t in expected.items()])
    seen = tagged.select(F.lower("surface").alias("word"), "base", "rules").filter(F.col("word").isin(list(expected))).groupBy("word", "base", "rules").agg(F.count("*").alias("n"))
    out = seen.groupBy("word").agg(F.sum("n").alias("occurrences")).withColumn("expected", of)
    for c in ("base", "rules"):
        by = seen.groupBy("word", F.col(c).alias("tag")).agg(F.sum("n").alias("n"))
        top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), 1, 4)
        shown = F.array_join(F.transform(top, lambda x: F.concat(x["tag"], F.lit(":"), (-x["m"]).cast("string"))), ", ")
        right = F.sum(F.when(F.col("tag") == of, F.col("n")).otherwise(0))
        out = out.join(by.groupBy("word").agg(shown.alias(f"{c}_tags"), F.round(1 - right / F.sum("n"), 3).alias(f"{c}_wrong_share")), "word")
    return out.withColumnRenamed("word", "term")


def shape(w: Column) -> Column:
    """Capitals X, small letters x, digits d; runs cut to two."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"[\p{Lu}]", "X"), r"[\p{Ll}]", "x"), r"[0-9]", "d")
    return F.regexp_replace(s, r"(.)\1+", "$1$1")


_PATTERNS = [(r"-?\d+(?:\s\d+)?/\d+", "CD"), (r"-?\d+(?:[.,]\d+)*%?", "CD"), (r".*ing", "VBG"), (r".*ed", "VBD"), (r".*es", "VBZ"), (r".*ly", "RB"), (r".*s", "NNS"), (r"[A-Z][a-z]+", "NNP")]


class BackoffTagger:
    """Trigram, bigram and unigram contexts (two tags before, one, none), then word shapes; trained from tagged sentences."""

    def __init__(self, sentences: list[list[tuple[str, str]]]):
        seen: list[dict] = [{}, {}, {}]
        for s in sentences:
            tags = [t for _, t in s]
            for i, (w, t) in enumerate(s):
                for n in range(3):
                    seen[n].setdefault((w, *tags[max(0, i - n) : i]) if i >= n else None, Counter())[t] += 1
        self.tables: list[dict] = []
        for n, table in enumerate(seen):  # a context is kept where it says more than the shorter ones
            kept = {}
            for key, c in table.items():
                if key is None:
                    continue
                best = min(c, key=lambda t: (-c[t], t))
                if n == 0 or self._at(key[0], list(key[1:]), n - 1) != best:
                    kept[key] = best
            self.tables.append(kept)

    def _at(self, w: str, before: list[str], n: int) -> str:
        for k in range(n, -1, -1):
            if len(before) >= k and k < len(self.tables) and (key := (w, *before[len(before) - k :])) in self.tables[k]:
                return self.tables[k][key]
        return next((t for p, t in _PATTERNS if re.fullmatch(p, w)), "NN")

    def tag(self, words: list[str]) -> list[str]:
        out: list[str] = []
        for w in words:
            out.append(self._at(w, out, 2))
        return out

    def column(self, words: Column) -> Column:
        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: self.tag(list(x)))

        return run(words)


def noun_phrases(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_no, phrase) by the pattern determiner? adjective* noun+ over tags; a substitute for a parser."""
    s = tokens.groupBy("doc_id", "sent_no").agg(F.sort_array(F.collect_list(F.struct("tok_no", "surface", "tag"))).alias("t"))
    kind = F.array_join(F.transform("t", lambda x: F.when(x["tag"].isin("DT", "PRP$"), "d").when(x["tag"].startswith("JJ"), "j").when(x["tag"].startswith("NN"), "n").when(x["tag"].startswith("VB"), "v").otherwise("o")), "")

    @F.pandas_udf("array<string>")
    def chunks(kinds: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([[" ".join(w[m.start() : m.end()]) for m in re.finditer("d?j*n+", k)] for k, w in zip(kinds, map(list, words))])

    return s.select("doc_id", "sent_no", F.explode(chunks(kind, F.transform("t", lambda x: x["surface"]))).alias("phrase"))


def verb_object_pairs(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_no, verb, object): a verb and the last noun of the phrase right after it; a substitute for a parser."""
    s = tokens.groupBy("doc_id", "sent_no").agg(F.sort_array(F.collect_list(F.struct("tok_no", "surface", "tag"))).alias("t"))
    kind = F.array_join(F.transform("t", lambda x: F.when(x["tag"].isin("DT", "PRP$"), "d").when(x["tag"].startswith("JJ"), "j").when(x["tag"].startswith("NN"), "n").when(x["tag"].startswith("VB"), "v").otherwise("o")), "")

    @F.pandas_udf("array<struct<verb: string, object: string>>")
    def pairs(kinds: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([[{"verb": w[m.start()], "object": w[m.end() - 1]} for m in re.finditer("vd?j*n+", k)] for k, w in zip(kinds, map(list, words))])

    return s.select("doc_id", "sent_no", F.explode(pairs(kind, F.transform("t", lambda x: x["surface"]))).alias("p")).select("doc_id", "sent_no", "p.*")


class HmmTagger:
    """Bigram hidden Markov model with Viterbi decoding; unseen words go by their shape and ending. A substitute for a CRF.

    Of equally good paths the one whose later tags come last in the alphabet is taken.
    """

    def __init__(self, sentences: list[list[tuple[str, str]]]):
        self.step, self.emit, self.end, self.n = Counter(), Counter(), Counter(), Counter()
        for s in sentences:
            before = "<s>"
            for w, t in s:
                self.step[before, t] += 1
                self.emit[t, w.lower()] += 1
                self.end[t, self._ending(w)] += 1
                self.n[t] += 1
                before = t
            self.step[before, "</s>"] += 1
        self.tags = sorted(self.n, reverse=True)
        self.words = {w for _, w in self.emit}
        self.out = Counter()
        for (a, _), c in self.step.items():
            self.out[a] += c
        # Row 0 is for endings that were never seen, then a row for each ending and each word.
        self._ends = {e: i + 1 for i, e in enumerate(sorted({e for _, e in self.end}))}
        self._known = {w: i + 1 + len(self._ends) for i, w in enumerate(sorted(self.words))}
        seen = [[0.0] * len(self.tags), *([0.1 * self.end[t, e] for t in self.tags] for e in self._ends), *([self.emit[t, w] for t in self.tags] for w in self._known)]
        self._scores = np.array([[log((x + 1e-3) / (self.n[t] + 1)) for t, x in zip(self.tags, row)] for row in seen])
        self._first, *steps = ([log((self.step[p, t] + 0.1) / (self.out[p] + 1)) for t in self.tags] for p in ("<s>", *self.tags))
        self._steps = np.array(steps)  # from, to

    @staticmethod
    def _ending(w: str) -> str:
        return "0" if re.search(r"\d", w) else "A" if w[:1].isupper() else w[-2:].lower()

    def _row(self, w: str) -> int:
        return self._known.get(w.lower()) or self._ends.get(self._ending(w), 0)

    def _paths(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tag numbers of sentences laid end to end, given the score row of each word; all sentences advance by a word at a time."""
        out, order = np.zeros(len(rows), np.int64), np.argsort(-sizes, kind="stable")
        start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # sentences of more than i words
        came: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        v = np.zeros((len(self.tags), 0))
        for i, n in enumerate(alive):
            own = self._scores[rows[start[:n] + i]].T
            if i == 0:
                v = np.array(self._first)[:, None] + own
                continue
            ends.append(v[:, n:].argmax(0))  # of the sentences that end here
            v = v[:, :n]
            if n < 16:
                each = v[:, None, :] + self._steps[:, :, None]
                back = each.argmax(0).astype(np.uint8)
                best = each.max(0)
            else:
                best, back = v[0] + self._steps[0][:, None], np.zeros(own.shape, np.uint8)
                for p in range(1, len(v)):
                    one = v[p] + self._steps[p][:, None]
                    back[one > best] = p
                    np.maximum(best, one, out=best)
            came.append(back)
            v = best + own
        ends.append(v.argmax(0))
        at = np.concatenate(ends[::-1])[: int(alive[0])] if len(alive) else np.zeros(0, np.int64)
        for i in range(len(alive) - 1, -1, -1):
            n = alive[i]
            out[start[:n] + i] = at[:n]
            if i:
                at[:n] = came[i - 1][at[:n], np.arange(n)]
        return out

    def tag_all(self, sentences: pa.ListArray, most: int = 1 << 20) -> pa.ListArray:
        """The tags of each sentence, about ``most`` words at a time; null for null."""
        parts, at, sizes = [], 0, pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        names = pa.array(self.tags or ["NN"], pa.string())
        for k in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1) if len(sizes) else ():
            words, own = sentences.slice(at, len(k)).flatten().dictionary_encode(), sizes[k]
            rows = np.array([self._row(w) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            parts.append(self._paths(rows, own) if self.tags else np.zeros(len(rows), np.int64))
            at += len(k)
        tags = names.take(pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.concatenate((sentences.is_null().to_numpy(zero_copy_only=False), [False])))
        return pa.ListArray.from_arrays(ends, tags)

    def tag(self, words: list[str]) -> list[str]:
        return self.tag_all(pa.array([words], pa.list_(pa.string())))[0].as_py()

    def column(self, words: Column) -> Column:
        @F.arrow_udf("array<string>")
        def run(s: pa.Array) -> pa.Array:
            return self.tag_all(s)

        return run(words)


def tagged_sample(docs: DataFrame, p: Pipeline, max_bytes: int = 1 << 20) -> list[list[tuple[str, str]]]:
    """Rule-tagged whole sentences of about ``max_bytes`` in all, or all of them if that is more, to train a tagger from.

    Every sentence of every document has the same chance, by a hash of its place and text.
    """
    total, span = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, 1 << 40
    sents = docs.select("doc_id", F.posexplode(K.split_sentences(F.col("text"), p.sentences)).alias("sent_no", "s"))
    sents = sents.filter(F.pmod(F.xxhash64("doc_id", "sent_no", "s"), F.lit(span)) < min(span, span * max_bytes // max(1, total)))
    toks = sents.select("doc_id", "sent_no", F.posexplode(K.tokenize(F.col("s"), p.tokenizer)).alias("tok_no", "surface"))
    rows = rule_tags(toks).groupBy("doc_id", "sent_no").agg(F.sort_array(F.collect_list(F.struct("tok_no", "surface", "tag"))).alias("t")).orderBy("doc_id", "sent_no").collect()
    return [[(x.surface, x.tag) for x in r.t] for r in rows]


def word_features(tokens: DataFrame) -> DataFrame:
    """Features of each token and its neighbours in the sentence, for a sequence model."""
    w = Window.partitionBy("doc_id", "sent_no").orderBy("tok_no")
    c = F.col("surface")
    own = {"low": F.lower(c), "suffix2": F.lower(F.substring(c, -2, 2)), "suffix3": F.lower(F.substring(c, -3, 3)), "prefix2": F.lower(F.substring(c, 1, 2)), "shape": shape(c), "capital": c.rlike(r"^[\p{Lu}]"), "upper": c.rlike(r"^[\p{Lu}]{2,}$"), "digit": c.rlike("[0-9]"), "hyphen": c.contains("-"), "slash": c.contains("/"), "number": c.rlike(NUMBER)}
    near = {"before": F.coalesce(F.lower(F.lag("surface").over(w)), F.lit("<s>")), "after": F.coalesce(F.lower(F.lead("surface").over(w)), F.lit("</s>")), "shape_before": F.coalesce(shape(F.lag("surface").over(w)), F.lit("")), "shape_after": F.coalesce(shape(F.lead("surface").over(w)), F.lit(""))}
    return tokens.withColumns(own | near)
