"""Licence scans: a trained paragraph classifier whose predictions are confirmed against templates.

A paragraph is a line. Its words' 1- to 3-grams are sparse binary features of a multinomial
logistic regression over licence families and an unknown class, trained in numpy on variations
of the templates and on a bounded sample of the corpus. Every feature holds a word that is rare
in ordinary text, so most paragraphs have none: their score is that of the unknown class and
they are dropped before anything is joined. Scanning uses DataFrame operations only.
"""

from __future__ import annotations

import json
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UNKNOWN = "unknown"
#: Notices by which the licences are known.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
#: Ordinary sentences with the words of licences.
_ORDINARY = (
    "She renewed her driving license at the office last week.", "He asked for permission to use the hall.", "The notice on the door was written in red.",
    "Our rights and duties are set out in the contract.", "The public library is open to any person.", "The version of the story he told was different.",
    "Software is distributed to all branches by the central team.", "She reserved a table for two.", "A free concert takes place in the park.", "The general conditions of trade apply.",
    "Copyright law is taught in the second year.", "The museum released a work by the artist.", "Commons and lords debated the bill.", "Creative people need time.",
)
_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(line: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", line.lower()) if w]


def grams_of(line: str) -> set[str]:
    w = words_of(line)
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def hashed(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


class LicenceModel:
    """Families, rare words, features with a weight for each class, and the bias."""

    def __init__(self, families, rare, features, weights, bias, temperature):
        self.families, self.rare, self.features, self.weights, self.bias, self.temperature = families, rare, features, weights, bias, temperature

    def probabilities(self, line: str) -> np.ndarray:
        z = (self.bias + sum((self.weights[self.features[g]] for g in sorted(grams_of(line)) if g in self.features), np.zeros(len(self.bias)))) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def _variations(line: str, rng, n: int = 12) -> list[str]:
    """The line, its halves, and copies with words lost or put before it."""
    w = line.split()
    out = [line, " ".join(w[: (2 * len(w) + 2) // 3]), " ".join(w[len(w) // 3 :])]
    for _ in range(n):
        kept = [x for x in w if rng.random() > 0.12]
        out.append(" ".join(["x%d" % rng.integers(99)] * int(rng.integers(3)) + kept))
    return out


def template_grams() -> set[str]:
    return set().union(*(grams_of(t) for ts in TEMPLATES.values() for t in ts))


def train(ordinary: list[str], common: dict[str, int] | None = None, n_lines: int = 0, seed: int = 3, steps: int = 400) -> LicenceModel:
    """From the templates' variations against ordinary lines of the corpus; those held out set the temperature and the unknown class.

    common has the number of ordinary lines with a word, of ``n_lines`` in all; without it the given lines are counted.
    """
    rng = np.random.default_rng(seed)
    of_templates = template_grams()
    ordinary = list({tuple(w for w in words_of(x) if not w.isdigit()): x for x in ordinary}.values())  # a line that repeats counts once
    lines = [x for x in ordinary if (g := [y for y in grams_of(x) if y.count(" ") == 2]) and sum(y in of_templates for y in g) < 0.5 * len(g)]  # licence lines of the corpus are not ordinary
    if common is None:
        common, n_lines = {}, len(lines)
        for x in lines:
            for w in set(words_of(x)):
                common[w] = common.get(w, 0) + 1
    few = max(3, 0.002 * n_lines)
    known = {w for g in of_templates for w in g.split() if common.get(w, 0) <= few and not w.isdigit() and len(w) > 1}
    for t in (t for ts in TEMPLATES.values() for t in ts):  # each template keeps a feature
        if not known & (own := {w for w in words_of(t) if not w.isdigit() and len(w) > 1}):
            known.add(min(own, key=lambda w: (common.get(w, 0), w)))
    rare = sorted(known)
    features = {g: i for i, g in enumerate(sorted(g for g in of_templates if known & set(g.split())))}
    families = [*sorted(TEMPLATES), UNKNOWN]

    def sparse(x: str) -> tuple:
        return tuple(sorted(features[g] for g in grams_of(x) if g in features))

    def drawn(n: int, own: list[str], skip=frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray, set]:
        """Distinct rows that are not in ``skip``, their classes, how often each was drawn, and the rows as a set."""
        rows: dict[tuple, float] = {}
        for k, f in enumerate(families[:-1]):
            for t in TEMPLATES[f]:
                for v in _variations(t, rng, n):
                    if (at := sparse(v)) and (at, k) not in skip:
                        rows[at, k] = rows.get((at, k), 0.0) + 1 + 2 * (v == t)
        for x in own:
            key = (sparse(x), len(families) - 1)
            rows[key] = rows.get(key, 0.0) + 1
        X = np.zeros((len(rows), len(features)), np.float32)
        for i, (at, _) in enumerate(rows):
            X[i, list(at)] = 1
        return X, np.array([k for _, k in rows]), np.minimum(np.array([*rows.values()]), 200.0), set(rows)

    # A fifth of the ordinary lines, every other of the fixed ones, and variations not learnt from are held out.
    held = {x for x in lines if xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % 5 == 0}
    Xl, yl, wl, learnt = drawn(16, [x for x in lines if x not in held] + [s for s in _ORDINARY[::2] for _ in range(20)])
    X, y, weight, _ = drawn(8, [*sorted(held), *(s for s in _ORDINARY[1::2] for _ in range(20))], learnt)
    W, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    m = [np.zeros_like(W), np.zeros_like(b)]
    v = [np.zeros_like(W), np.zeros_like(b)]
    for step in range(steps):
        z = Xl @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(yl)), yl] -= 1
        p *= (wl / wl.sum())[:, None]
        for i, (x, g) in enumerate(((W, Xl.T @ p + 1e-5 * W), (b, p.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.05 * m[i] / (1 - 0.9 ** (step + 1)) / (np.sqrt(v[i] / (1 - 0.999 ** (step + 1))) + 1e-9)
    z = X @ W + b
    unknown = np.eye(len(families))[-1]

    def loss(at: tuple[float, float]) -> float:
        """On what was held out, for a temperature and a shift of the unknown class."""
        q = (z + at[1] * unknown) / at[0]
        return float((weight * (np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(y)), y])).sum())

    temperature, shift = min(((t, s) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0) for s in (0.0, -2.0, -1.0, -0.5, 0.5, 1.0, 2.0)), key=loss)
    b = b + shift * unknown
    b[-1] = max(b[-1], b[:-1].max())  # what has no feature is unknown: on this rests that such lines are left out unread
    return LicenceModel(families, rare, features, W, b, temperature)


def fit(docs: DataFrame, sample_docs: int = 300, max_bytes: int = 20_000) -> LicenceModel:
    """Trains with the lines of about ``sample_docs`` documents, none over ``max_bytes``, as ordinary text; both bounds touch the weights only.

    Which words are rare is counted over the lines of all documents.
    """
    some = docs.select("doc_id", "text").filter((F.octet_length("text") <= max_bytes) & F.col("doc_id").isNotNull())
    n = max(1, some.count())
    span = 1 << 30
    rows = some.filter(F.pmod(F.xxhash64("doc_id", F.lit("licences")), F.lit(span)) < min(span, span * sample_docs // n)).collect()
    return train([line for r in sorted(rows) for line in r[1].split("\n") if line.strip()], *line_counts(docs))


def line_counts(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Ordinary lines of all documents that hold each word of the templates, and all of them.

    Lines that differ in numbers only count once, so that a notice below every page of a source
    is one line; the counts of distinct lines are approximate (5 %), in one pass that keeps a
    sketch for each word of a fixed list. As in training, lines are left out that have no three
    words or half of whose trigrams are a template's.
    """
    grams = template_grams()
    vocabulary = sorted({w for g in grams for w in g.split()})
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.filter(F.split(F.lower("line"), _SPLIT), lambda w: w != "").alias("words"))
    lines = lines.select(F.explode(F.array("words")).alias("words")).filter(F.size("words") >= 3)  # keeps the split out of the lambdas below
    lines = lines.withColumn("own", F.filter("words", lambda w: w.isin(vocabulary)))
    trigrams = F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.concat_ws(" ", F.slice("words", i, 3)))
    licence = F.size(F.filter(F.array_distinct(trigrams), lambda g: g.isin(sorted(g for g in grams if g.count(" ") == 2)))) >= 0.5 * F.size(F.array_distinct(trigrams))
    # Trigrams of templates hold their words only: most lines have too few of these.
    lines = lines.filter(~F.when(3 * F.size("own") >= F.size("words"), licence).otherwise(F.lit(False)))
    digest = F.xxhash64(F.filter("words", lambda w: ~w.rlike("^[0-9]+$")))
    lines = lines.select(F.explode(F.array(F.struct(digest.alias("h"), F.array_distinct("own").alias("own")))).alias("x"))  # once a line, not once a word
    lines = lines.select(F.col("x.h").alias("h"), F.explode(F.concat(F.array(F.lit("")), "x.own")).alias("w"))
    counts = {r[0]: r[1] for r in lines.groupBy("w").agg(F.approx_count_distinct("h")).collect()}
    return counts, counts.pop("", 0)


def _grams(words: Column) -> Column:
    """Hashes of the distinct 1- to 3-grams of an array of words."""
    n = F.size(words)
    parts = [words]

    def run_of(k: int):
        return lambda i: F.concat_ws(" ", F.slice(words, i, k))

    for k in (2, 3):
        parts.append(F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), run_of(k))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(F.concat(*parts), lambda g: F.xxhash64(g)))


def _literal(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small table from a constant, made by the JVM."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.5, similar: float = 0.5) -> DataFrame:
    """doc_id, paragraph (line number from 0), family, probability, template, similarity, confirmed.

    A row for each paragraph whose likeliest family has at least ``least``; the others are
    unknown and left out. similarity is the share of the paragraph's distinct n-grams, or of the
    template's if that is more, found in the most similar template of the family; confirmed if
    it reaches ``similar``. Null and empty texts have no paragraphs; rows repeated whole give
    their rows as often. An empty table gives an empty result; other columns are ignored.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.withColumn("words", F.filter(F.split(F.lower("line"), _SPLIT), lambda w: w != ""))
    # No feature is without a rare word: all other paragraphs are unknown by the bias alone.
    lines = lines.filter(F.arrays_overlap("words", F.array(*map(F.lit, model.rare)))).groupBy("doc_id", "paragraph", "line").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    templates = [(f, i, sorted(grams_of(t))) for f, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts)]
    known = sorted({hashed(g) for _, _, gs in templates for g in gs})
    # A paragraph goes on as its digest and those of its n-grams that a template has: long lines are not carried along.
    grams = lines.select("doc_id", "paragraph", F.md5(F.col("line").cast("binary")).alias("line"), "copies", _grams(F.col("words")).alias("gs"))
    grams = written(grams.select("doc_id", "paragraph", "line", "copies", F.size("gs").alias("own"), F.filter("gs", lambda g: g.isin(known)).alias("gs")), "licence-grams")
    n = len(model.families)
    weights = _literal(docs, [{"g": hashed(g), "w": [round(float(x), 9) for x in model.weights[i]]} for g, i in sorted(model.features.items())], "g: bigint, w: array<double>")
    key = ["doc_id", "paragraph", "line", "copies", "own"]
    each = grams.select(*key, "gs", F.explode("gs").alias("g")).join(F.broadcast(weights), "g", "left")  # a row for each feature of the templates
    logit = each.groupBy(*key, "gs").agg(*[(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) + F.lit(float(model.bias[k]))).alias(f"z{k}") for k in range(n)])
    z = F.array(*[F.col(f"z{k}") / F.lit(float(model.temperature)) for k in range(n)])
    best = logit.withColumn("z", z).withColumn("top", F.array_max("z"))
    best = best.withColumn("total", F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).withColumn("k", F.array_position("z", F.col("top")).cast("int"))
    best = best.withColumn("probability", 1 / F.col("total")).filter((F.col("k") < n) & (F.col("probability") >= least))
    named = best.select(*key, "gs", F.element_at(F.array(*map(F.lit, model.families)), F.col("k")).alias("family"), "probability")
    # Template comparison over all n-grams.
    shelf = _literal(docs, [{"family": f, "template": i, "size": len(g), "gs": list(map(hashed, g))} for f, i, g in templates], "family: string, template: int, size: int, gs: array<bigint>").select("family", "template", "size", F.explode("gs").alias("g"))
    spelled = named.select(*key, "family", "probability", F.explode("gs").alias("g"))
    shared = spelled.join(F.broadcast(shelf), ["family", "g"]).groupBy(*key, "family", "probability", "template", "size").agg(F.count("*").alias("shared"))
    shared = shared.withColumn("similarity", F.greatest(F.col("shared") / F.col("own"), F.col("shared") / F.col("size")))
    closest = shared.groupBy(*key, "family", "probability").agg(F.max(F.struct("similarity", -F.col("template"))).alias("m"))
    out = closest.select("doc_id", "paragraph", "family", "probability", (-F.col("m").getField("col2")).alias("template"), F.col("m.similarity").alias("similarity"), "copies")
    return out.withColumn("confirmed", F.col("similarity") >= similar).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
