"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as its own vector (words of the training sample's vocabulary, else one vector
for the unknown) and the mean vector of its hashed character trigrams. Overlapping windows of
``WINDOW`` words, ``STRIDE`` apart, cover the whole text; a document's score is that of its
highest window, which is also the one that learns in training.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unit_bpe
from .common import bounded_sample, id_crc

WINDOW, STRIDE = 32, 16
HIDDEN, WORD, CHAR, ATTEND, CHAR_BITS = 8, 12, 8, 8, 12
_SEPARATE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_KNOWN_WORDS = 150_000


def words_of(lower: bytes) -> list[bytes]:
    return lower.translate(_SEPARATE).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words (with their edges), and how many each word has."""
    b = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 2)
    keep = np.ones(len(b), bool)
    keep[ends - 1] = keep[ends - 2] = False
    at = np.flatnonzero(keep)
    code = b[at] << np.uint32(16) | b[at + 1] << np.uint32(8) | b[at + 2]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS), n


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words."""
    return np.arange(max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and both passes; inputs are word projections of shape (time, windows, 6 HIDDEN)."""

    def __init__(self, n_words: int, rng):
        g = lambda *s, scale=None: rng.normal(0, scale or 1 / math.sqrt(s[0]), s).astype(np.float32)
        h, d = HIDDEN, WORD + CHAR
        self.p = {
            "E": g(n_words + 1, WORD, scale=0.1), "C": g(1 << CHAR_BITS, CHAR, scale=0.1), "X": g(d, 6 * h), "x": np.zeros(6 * h, np.float32),
            "U0": g(h, 3 * h), "U1": g(h, 3 * h), "c0": np.zeros(h, np.float32), "c1": np.zeros(h, np.float32),
            "A": g(2 * h, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": g(ATTEND), "w": g(2 * h), "b": np.zeros(1, np.float32),
        }

    def inputs(self, ids: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["C"][grams], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None] if len(ids) else np.zeros((0, CHAR), np.float32)
        return np.concatenate([self.p["E"][ids], chars.astype(np.float32)], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["X"] + self.p["x"]

    @staticmethod
    def padding() -> np.ndarray:
        """A projection that leaves the state as it is: the update gate is shut."""
        one = np.zeros(3 * HIDDEN, np.float32)
        one[:HIDDEN] = 40
        return np.concatenate([one, one])

    def _gru(self, P, U, c, keep):
        T, B, h = P.shape[0], P.shape[1], HIDDEN
        H, saved = np.zeros((T + 1, B, h), np.float32), []
        for t in range(T):
            g = H[t] @ U
            zr = _sigmoid(P[t, :, : 2 * h] + g[:, : 2 * h])
            gn = g[:, 2 * h :] + c
            n = np.tanh(P[t, :, 2 * h :] + zr[:, h:] * gn)
            H[t + 1] = n + zr[:, :h] * (H[t] - n)
            if keep:
                saved.append((zr, gn, n))
        return H, saved

    def forward(self, P: np.ndarray, pad: np.ndarray, keep: bool = False):
        """Logits of the windows; pad marks places after the last word."""
        p, h = self.p, HIDDEN
        H0, s0 = self._gru(P[:, :, : 3 * h], p["U0"], p["c0"], keep)
        H1, s1 = self._gru(P[::-1, :, 3 * h :], p["U1"], p["c1"], keep)
        H = np.concatenate([H0[1:], H1[:0:-1]], axis=2)
        u = np.tanh(H @ p["A"] + p["a"])
        s = u @ p["v"]
        s = np.where(pad, np.float32(-1e9), s)
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, H)
        return pooled @ p["w"] + p["b"][0], (H0, s0, H1, s1, H, u, alpha, pooled)

    def _gru_back(self, dH, H, saved, U):
        h, dh = HIDDEN, np.zeros_like(H[0])
        dP, dU, dc = np.zeros((*dH.shape[:2], 3 * h), np.float32), np.zeros_like(U), np.zeros(h, np.float32)
        for t in range(len(saved) - 1, -1, -1):
            zr, gn, n = saved[t]
            z, r = zr[:, :h], zr[:, h:]
            dh = dh + dH[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr, dgn = dh * (H[t] - n) * z * (1 - z), dn * gn * r * (1 - r), dn * r
            dP[t] = np.concatenate([dz, dr, dn], axis=1)
            dG = np.concatenate([dz, dr, dgn], axis=1)
            dU += H[t].T @ dG
            dc += dgn.sum(axis=0)
            dh = dh * z + dG @ U.T
        return dP, dU, dc

    def backward(self, dlogit: np.ndarray, state) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the projection, and of the projection."""
        p, (H0, s0, H1, s1, H, u, alpha, pooled) = self.p, state
        g = {"w": pooled.T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["w"]
        dalpha = np.einsum("bh,tbh->tb", dpool, H)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["v"], g["A"], g["a"] = np.einsum("tb,tbk->k", ds, u), np.einsum("tbh,tbk->hk", H, du), du.sum(axis=(0, 1))
        dH = alpha[:, :, None] * dpool + du @ p["A"].T
        dP0, g["U0"], g["c0"] = self._gru_back(dH[:, :, :HIDDEN], H0, s0, p["U0"])
        dP1, g["U1"], g["c1"] = self._gru_back(dH[::-1, :, HIDDEN:], H1, s1, p["U1"])
        return g, np.concatenate([dP0, dP1[::-1]], axis=2)


class ToxicityModel:
    """A trained network, its vocabulary and the calibration of its logit."""

    def __init__(self, vocab: dict[bytes, int], net: Network, scale: float, shift: float):
        self.vocab, self.net, self.scale, self.shift = vocab, net, scale, shift
        self._forget()
        unit_bpe.HELD.add(self)

    def __getstate__(self):
        return self.vocab, self.net, self.scale, self.shift

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self):
        self.at, self.table = {}, np.zeros((1024, 6 * HIDDEN), np.float32)
        self.table[0] = Network.padding()

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words' projections; each new word is projected once while the memory (``_KNOWN_WORDS``) lasts."""
        if len(self.at) > _KNOWN_WORDS:
            self._forget()
        at = np.fromiter(map(self.at.get, words, [-1] * len(words)), np.int64, len(words))
        if (at < 0).any():
            new = list(dict.fromkeys(words[i] for i in np.flatnonzero(at < 0)))
            first = len(self.at) + 1
            self.at.update(zip(new, range(first, first + len(new))))
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            ids = np.fromiter(map(self.vocab.get, new, [0] * len(new)), np.int64, len(new))
            self.table[first : first + len(new)] = self.net.project(self.net.inputs(ids, *trigrams(new)))
            at = np.fromiter(map(self.at.get, words), np.int64, len(words))
        return at

    def logits(self, docs: list[list[bytes]], at_once: int = 1024) -> np.ndarray:
        """Of the highest window of each document."""
        out, held, owners, size = np.full(len(docs), -np.inf), [], [], 0

        def flush():
            nonlocal held, owners, size
            if size:
                idx = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
                for i in range(0, size, at_once):
                    part = idx[:, i : i + at_once]
                    logit, _ = self.net.forward(self.table[part], part == 0)
                    np.maximum.at(out, np.concatenate(owners)[i : i + at_once], logit)
            held, owners, size = [], [], 0

        for k, words in enumerate(docs):
            for i in range(0, max(1, len(words)), 1 << 16):  # very long texts in overlapping parts
                part = words[i : i + (1 << 16) + WINDOW]
                if len(self.at) + len(part) > 2 * _KNOWN_WORDS:
                    flush()
                    self._forget()
                first = windows(len(part))
                idx = np.zeros(int(first[-1]) + WINDOW, np.int64)
                if len(part):
                    if len(self.at) > _KNOWN_WORDS:
                        flush()
                    idx[: len(part)] = self.rows(part)
                held.append(idx[first[None, :] + np.arange(WINDOW)[:, None]])
                owners.append(np.full(len(first), k))
                size += len(first)
                if size >= 4 * at_once:
                    flush()
        flush()
        return out

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60)))


def train(texts: list[bytes], labels: list[int], prior: float, steps: int = 500, batch: int = 32, seed: int = 5, max_words: int = 20_000) -> ToxicityModel:
    """From lower-case texts and 0/1 labels. A fifth of the rows calibrates the logit at the labels' own ``prior``."""
    rng = np.random.default_rng(seed)
    docs, y = [words_of(t) for t in texts], np.array(labels, np.float32)
    order = rng.permutation(len(docs))
    held, learn = order[: len(docs) // 5], order[len(docs) // 5 :]
    seen: list[dict[bytes, int]] = [{}, {}]
    for i in learn:
        for w in set(docs[i]):
            seen[int(y[i])][w] = seen[int(y[i])].get(w, 0) + 1
    both = {w: seen[0].get(w, 0) + seen[1].get(w, 0) for w in {**seen[0], **seen[1]}}
    ranked = sorted((w for w, n in both.items() if n >= 3), key=lambda w: (-both[w], w))[:max_words]
    vocab = {w: i + 1 for i, w in enumerate(ranked)}
    net = Network(len(vocab), rng)
    n1, n0 = max(1, int(y[learn].sum())), max(1, int((1 - y[learn]).sum()))
    for w, i in vocab.items():  # a start from the words' log odds shortens training
        net.p["E"][i, 0] = np.clip(0.5 * math.log((seen[1].get(w, 0) + 0.5) / n1 / ((seen[0].get(w, 0) + 0.5) / n0)), -2, 2)
    model = ToxicityModel(vocab, net, 1.0, 0.0)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    pools = [learn[y[learn] == k] for k in (0, 1)]
    if min(map(len, pools)):
        for step in range(steps):
            part = np.concatenate([rng.choice(pool, batch // 2) for pool in pools])
            words = list(dict.fromkeys(w for i in part for w in docs[i]))
            place = {w: k + 1 for k, w in enumerate(words)}
            ids = np.fromiter(map(vocab.get, words, [0] * len(words)), np.int64, len(words))
            ids[rng.random(len(ids)) < 0.1] = 0  # so that characters learn too
            grams, sizes = trigrams(words)
            x = net.inputs(ids, grams, sizes)
            table = np.concatenate([Network.padding()[None], net.project(x)])
            cols, owner = [], []
            for k, i in enumerate(part):
                first = windows(len(docs[i]))
                idx = np.zeros(int(first[-1]) + WINDOW, np.int64)
                idx[: len(docs[i])] = [place[w] for w in docs[i]]
                cols.append(idx[first[None, :] + np.arange(WINDOW)[:, None]])
                owner.append(np.full(len(first), k))
            idx, owner = np.concatenate(cols, axis=1), np.concatenate(owner)
            logit, _ = net.forward(table[idx], idx == 0)
            top = np.array([np.flatnonzero(owner == k)[logit[owner == k].argmax()] for k in range(len(part))])
            idx = idx[:, top]
            logit, state = net.forward(table[idx], idx == 0, keep=True)
            grad, dP = net.backward(((1 / (1 + np.exp(-logit)) - y[part]) / len(part)).astype(np.float32), state)
            flat = idx.ravel()
            used = flat > 0
            drow = np.zeros((len(words), dP.shape[2]), np.float32)
            np.add.at(drow, flat[used] - 1, dP.reshape(-1, dP.shape[2])[used])
            grad["X"], grad["x"] = x.T @ drow, drow.sum(axis=0)
            dx = drow @ net.p["X"].T
            grad["E"], grad["C"] = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(grad["E"], ids, dx[:, :WORD])
            hot = np.flatnonzero(np.abs(dx).sum(axis=1) > 0)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for k in hot:
                np.add.at(grad["C"], grams[starts[k] : starts[k + 1]], dx[k, WORD:] / sizes[k])
            rate = 0.01 * (1 - 0.8 * step / steps)
            for k, d in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (step + 1))) + 1e-8)).astype(np.float32)
    model._forget()
    check = held if min((y[held] == k).sum() for k in (0, 1)) >= 20 else order
    if not len(check):
        return model
    s, t = model.logits([docs[i] for i in check]), y[check].astype(float)
    share = min(max(t.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(t > 0, min(max(prior, 1e-3), 0.999) / share, (1 - min(max(prior, 1e-3), 0.999)) / (1 - share)) / len(t)

    def loss(at: tuple[float, float]) -> float:
        z = np.where(t > 0, -1, 1) * (at[0] * s + at[1])
        return float((weight * np.logaddexp(0, z)).sum() + 1e-3 * (at[0] - 1) ** 2 + 1e-4 * at[1] ** 2)

    model.scale, model.shift = min(((a, b) for a in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8) for b in np.arange(-10, 10.25, 0.25).tolist()), key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 20_000, folds: int = 5) -> ToxicityModel:
    """Trains on labelled documents outside fold 0: about ``per_class`` of each label, none over ``max_bytes``.

    Where all texts of a label are longer, a window of ``max_bytes`` characters of each, at a
    place given by its hash, is learnt from, so that no label goes without. Both bounds keep the
    sample (broadcast to find its texts, then on the driver) small; they touch training only.
    Labels are joined by doc_id; null labels and unlabelled rows teach nothing, a document with
    both labels counts as toxic, and of texts that share an id the first by length and alphabet
    is learnt from.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(F.pmod(id_crc(), F.lit(folds)) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    sample = bounded_sample(known, "toxic", per_class)
    over = F.octet_length("text") > max_bytes
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - max_bytes, F.lit(0)) + 1).cast("int")
    part = F.struct(over.alias("over"), F.when(over, F.substring("text", at + 1, F.lit(max_bytes))).otherwise(F.col("text")).alias("text"))
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(part).alias("t")).select("doc_id", "toxic", "t.text", "t.over").collect()
    short = {r.toxic for r in rows if not r.over}
    rows = sorted(r for r in rows if not r.over or r.toxic not in short)
    return train([r.text.lower().encode("utf-8", "surrogatepass") for r in rows], [r.toxic for r in rows], prior)


def _scores(m: ToxicityModel, column) -> np.ndarray:
    lower = pc.cast(pc.utf8_lower(pc.fill_null(column, "")), pa.binary())
    return m.score(m.logits([words_of(t) for t in lower.to_pylist()]))


def score_documents(docs: DataFrame, model: ToxicityModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the whole text is read.

    A null or empty text has the score of no words at all. A row without doc_id is not held
    out. Repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        unit_bpe.forget(sent.value)
        for b in batches:
            for part in unit_bpe.slices(b, "text", 256):
                s = _scores(sent.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(id_crc(), F.lit(folds)) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        unit_bpe.forget(sent.value)
        for b in batches:
            for part in unit_bpe.slices(b, "text", 256):
                yield part.filter(pa.array(_scores(sent.value, part.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
