"""Language identification: averaged hashed sub-word embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unit_bpe
from .common import bounded_sample, id_crc

GRAMS = (2, 3, 4)
_LETTERS_ONLY = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def buckets_of(text: bytes, bits: int) -> np.ndarray:
    """Hash buckets of all byte n-grams of lower-case text; what is no letter counts as a word's edge."""
    b = np.frombuffer(b" " + text.translate(_LETTERS_ONLY) + b" ", np.uint8).astype(np.uint32)
    out, code = [], b
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] << np.uint32(8) | b[n - 1 :]
        out.append((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - bits))
        if len(code) < 2:
            break
    return np.concatenate(out)


class LanguageModel:
    """Embeddings E, weights W and bias; at scoring time E W is one table of a row for each bucket."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject: float, bits: int):
        self.languages, self.table, self.bias, self.temperature, self.reject, self.bits = languages, table, bias, temperature, reject, bits

    def probabilities(self, text: bytes, step: int = 1 << 20) -> np.ndarray:
        """Of the whole text, read in overlapping steps to bound the memory."""
        total, n = np.zeros(len(self.languages)), 0
        for i in range(0, max(1, len(text)), step):
            at = buckets_of(text[max(0, i - max(GRAMS) + 1) : i + step], self.bits)
            total += self.table[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def train(rows: list[tuple[str, str]], bits: int = 16, dim: int = 16, epochs: int = 6, window: int = 256, seed: int = 7) -> LanguageModel | None:
    """From (text, lang). A fifth of the rows sets the temperature and the rejection threshold (1 % of right answers fall below)."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    grams = [buckets_of(t.lower().encode("utf-8", "surrogatepass"), bits) for t, _ in rows]
    y = np.array([languages.index(lang) for _, lang in rows])
    order = rng.permutation(len(rows))
    held, order = order[: len(rows) // 5], order[len(rows) // 5 :]
    if not len(held):
        held = order
    L = len(languages)
    share = np.bincount(y[order], minlength=L) / max(1, len(order))
    weight = 1 / np.maximum(share * L, 0.05)
    E = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    W, bias = rng.normal(0, 0.3, (dim, L)).astype(np.float32), np.zeros(L, np.float32)
    steps, done = epochs * max(1, len(order) // 32), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(order), max(1, len(order) // 32)):
            rate = 2.0 * (1 - done / steps) + 0.02
            done += 1
            at = np.stack([grams[i][rng.integers(0, len(grams[i]), window)] for i in part])
            hidden = E[at].mean(axis=1)
            z = hidden @ W + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[y[part]][:, None] / len(part)
            back = (p @ W.T) / window * 20  # the mean spreads the gradient thin over the window
            W -= rate * hidden.T @ p
            bias -= rate * p.sum(axis=0)
            np.subtract.at(E, at.ravel(), np.repeat(rate * back, window, axis=0).astype(np.float32))
    model = LanguageModel(languages, (E @ W).astype(np.float32), bias.astype(np.float64), 1.0, 0.0, bits)
    raw = np.stack([np.log(model.probabilities(rows[i][0].lower().encode("utf-8", "surrogatepass")) + 1e-12) for i in held])

    def loss(t: float) -> float:
        z = raw / t
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(held)), y[held]]).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    z = raw / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.max(1)[p.argmax(1) == y[held]]
    model.reject = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, per_language: int = 1200, max_chars: int = 20_000, folds: int = 3, test_fold: int = 1) -> LanguageModel | None:
    """Trains on documents with a language outside the test fold: about ``per_language`` of each.

    Of a text of more than ``max_chars`` characters a window at a place given by its hash is
    learnt from. Both bounds keep the sample small on the driver; they touch training only.
    """
    known = docs.filter((F.pmod(id_crc(), F.lit(folds)) != test_fold) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    at = F.when(F.length("text") > max_chars, F.pmod(F.xxhash64("text"), F.length("text") - max_chars + 1)).otherwise(0).cast("int")
    part = known.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.substring("text", at + 1, F.lit(max_chars)).alias("text"))
    rows = bounded_sample(part, "lang", per_language, "doc_id", "h").select("doc_id", "text", "lang").distinct().collect()
    return train([(r[1], r[2]) for r in sorted(rows)])


def identify(docs: DataFrame, model: LanguageModel | None, folds: int = 3, test_fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    lang_pred is the likeliest learned language, ``und`` (score 0) if the text is null or has no
    letter or nothing was learned; rejected marks scores below the calibrated threshold and
    ``und``. A row without doc_id is not held out. Repeated rows repeat; an empty table gives
    an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in (part for x in batches for part in unit_bpe.slices(x, "text", 1024)):
            lower = pc.cast(pc.utf8_lower(b.column("text")), pa.binary())
            pred, score, low = [], [], []
            for text, letter in zip(lower.to_pylist(), b.column("letter").to_pylist()):
                if m is None or not letter:
                    pred.append("und")
                    score.append(0.0)
                    low.append(True)
                    continue
                p = m.probabilities(text)
                k = int(p.argmax())
                pred.append(m.languages[k])
                score.append(float(p[k]))
                low.append(bool(p[k] < m.reject))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.pmod(id_crc(), F.lit(folds)) == test_fold, F.lit(False))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", held.alias("held_out"), text.alias("text"), text.rlike(r"\p{L}").alias("letter")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
