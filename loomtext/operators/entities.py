"""Entities by lexicon: token patterns joined to n-gram windows, and overlaps resolved."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import hybrid_spans, hybrid_tokens

# Shapes of single tokens.
SHAPES = [("MONEY", r"[₹$€£]\d[\d,]*(\.\d+)?"), ("DATE", r"\d{4}-\d{2}-\d{2}(T[\d:]+)?")]


def is_name(term: str) -> bool:
    """Names (two capitals or a digit) match in their own case only."""
    return bool(re.search(r"[A-Z].*[A-Z]|\d", term))


def patterns(lexicon: list[tuple[str, str]]) -> list[tuple[str, str, bool]]:
    """(tokens joined by spaces, label, exact case) from (term, label), with plural forms of what is no name."""
    out = []
    for term, label in lexicon:
        toks = hybrid_tokens(term)
        if is_name(term):
            out.append((" ".join(toks), label, True))
            continue
        *head, last = (t.lower() for t in toks)
        ends = {last, last + "s", last + "es"} | ({last[:-1] + "ies"} if last.endswith("y") else set())
        out += [(" ".join([*head, e]), label, False) for e in sorted(ends)]
    return out


def gazetteer(tokens: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(doc_id, sent_no, tok_no, n, phrase, label): windows of up to ``longest`` tokens joined to (phrase, label, exact)."""
    s = tokens.groupBy("doc_id", "sent_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("tok_no", "surface"))), lambda x: x["surface"]).alias("t"))
    starts = s.select("doc_id", "sent_no", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i"))
    grams = starts.select("doc_id", "sent_no", F.col("i").alias("tok_no"), "t", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("t") - F.col("i") + 1))).alias("n"))
    text = F.array_join(F.slice("t", F.col("tok_no"), F.col("n")), " ")
    grams = grams.select("doc_id", "sent_no", (F.col("tok_no") - 1).alias("tok_no"), "n", text.alias("seen"), F.lower(text).alias("phrase"))
    exact = table.filter("exact").select(F.col("phrase").alias("seen"), "label")
    loose = table.filter("not exact").select("phrase", "label")
    cols = ["doc_id", "sent_no", "tok_no", "n"]
    return grams.join(loose, "phrase").select(*cols, "phrase", "label").union(grams.join(exact, "seen").select(*cols, F.col("seen").alias("phrase"), "label"))


def _matches(text: str, rules: dict, longest: int) -> list[tuple[str, str, int, int, str]]:
    """Longest match first among those at the same place; no overlaps."""
    spans = hybrid_spans(text)
    found = []
    for i in range(len(spans)):
        for n in range(min(longest, len(spans) - i), 0, -1):
            words = [text[s:e] for s, e in spans[i : i + n]]
            label = rules.get((" ".join(words), True)) or rules.get((" ".join(words).lower(), False))
            if label is None and n == 1:
                label = next((k for k, p in SHAPES if re.fullmatch(p, words[0])), None)
            if label is None and n == 2 and words[0].lower() in ("rs", "rs.", "inr") and re.fullmatch(r"\d[\d,]*(\.\d+)?", words[1]):
                label = "MONEY"
            if label:
                found.append((n, i, label))
    out, taken = [], set()
    for n, i, label in sorted(found, key=lambda f: (-f[0], f[1])):
        if not taken & set(range(i, i + n)):
            taken |= set(range(i, i + n))
            s, e = spans[i][0], spans[i + n - 1][1]
            out.append((text[s:e], label, s, e, "ruler"))
    return sorted(out, key=lambda x: x[2])


def entities(text, lexicon: list[tuple[str, str]], keep: list[str] | None = None):
    """array of struct(text, label, start, end, source) for a column of texts; the lexicon is small configuration."""
    rules = {(p, exact): label for p, label, exact in reversed(patterns(lexicon))}
    longest = max((p.count(" ") + 1 for p, _ in rules), default=1)

    @F.pandas_udf("array<struct<text: string, label: string, start: int, end: int, source: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("text", "label", "start", "end", "source"), m)) for m in _matches(t or "", rules, longest) if keep is None or m[1] in keep])

    return run(text)


# The colours of marked entities.
COLOURS = {"CONCEPT": "#c7e3ff", "MISCONCEPTION": "#ffd0d0", "KT_MODEL": "#e0d4ff", "DATASET": "#d4f5dc", "METRIC": "#fff1bf"}


def marked_html(text, found, colours: dict[str, str] | None = None):
    """HTML of a text column with the spans of an entity column (start, end, label, in order) marked and labelled."""
    colours = COLOURS if colours is None else colours
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    between = lambda a, b: escaped(F.substring(text, a + 1, b - a))

    def step(acc, e):
        colour = F.coalesce(*[F.when(e["label"] == k, F.lit(v)) for k, v in colours.items()], F.lit("#dddddd"))
        mark = F.concat(F.lit('<mark style="background: '), colour, F.lit('">'), between(e["start"], e["end"]), F.lit(" <span>"), e["label"], F.lit("</span></mark>"))
        return F.struct(F.concat(acc["html"], between(acc["at"], e["start"]), mark).alias("html"), e["end"].alias("at"))

    done = F.aggregate(found, F.struct(F.lit("").alias("html"), F.lit(0).alias("at")), step)
    return F.concat(F.lit('<div class="entities">'), done["html"], between(done["at"], F.length(text)), F.lit("</div>"))
