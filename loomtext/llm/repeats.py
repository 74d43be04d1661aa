"""Repeated byte strings across documents by an enhanced suffix array and its common-prefix interval tree.

Candidates. The minimal hash among the ``K``-byte strings of a window of ``min_len`` bytes is
its anchor. Equal windows have the same anchor at the same place, so a window can only repeat
if its anchor does. Consecutive windows with one anchor make a context: the bytes from the
first window's start to the last one's end. Contexts whose anchor is unique are dropped; equal
contexts of one anchor are represented by one of them and their number.

Repeats. The contexts of an anchor go into one sparse suffix array (the starts of windows
only). A stack scan over its common prefixes visits the intervals of the prefix tree; one of
at least ``min_len`` bytes whose members differ in the byte before (or begin their context) is
a maximal repeat, and all its members are occurrences.

Passages. The same is done with words for bytes: a text is the string of its words' 32-bit
hashes, windows are ``n_words`` words, and an interval counts if its members come from more
than one document. Both kinds go through the stages together, told apart by ``u``, the bytes
of a symbol (1 or 4).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unit_bpe
from .common import discard, text_bytes, written

K, K_WORDS = 64, 16
_PRIME = 0x100000001B3 * 2 + 1
_SEGMENT, _PLACE = 1 << 22, (1 << 23) - 1
#: Contexts of one anchor that are taken into memory; an anchor with more is resolved by window hashes.
CONTEXTS = 20_000
#: Suffixes of one array in memory.
SUFFIXES = 150_000
_SPAN = "a long, c long, s int, e int"
_WORDS = 1 << 20


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n-byte strings, from those of powers of two."""
    base, size, h, out, used = _PRIME, 1, x.astype(np.uint64) + np.uint64(1), None, 0
    while size <= n:
        step = np.uint64(base)
        if n & size:
            out = h[: len(x) - n + 1] if out is None else out * step + h[used : used + len(x) - n + 1]
            used += size
        h = h[:-size] * step + h[size:] if len(h) > size else h[:0]
        base, size = base * base & (1 << 64) - 1, size * 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    """base^0, base^1, ... below 2^64, for one part of a text."""
    out, n, step = np.ones(_WORDS + 1, np.uint64), 1, base
    while n < len(out):
        out[n : 2 * n] = out[: len(out[n : 2 * n])] * np.uint64(step)
        n, step = 2 * n, step * step & (1 << 64) - 1
    return out


def word_codes(text: bytes) -> np.ndarray:
    """A 32-bit hash of each word; words are what white space (ASCII) separates, cut after ``_WORDS`` bytes."""
    out, at = [], 0
    up, down = _powers(_PRIME), _powers(pow(_PRIME, -1, 1 << 64))
    while at < len(text):
        end = min(len(text), at + _WORDS)
        if end < len(text):  # a part ends with white space, if there is any
            end = max((text.rfind(c, at, end) + 1 for c in (b" ", b"\n", b"\t")), default=0) or end
        x = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.concatenate(([False], (x != 32) & ((x < 9) | (x > 13)), [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * up[: len(x)])))
        h = (sums[last] - sums[first]) * down[first]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(32)).astype(np.uint32))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def symbols(text: bytes, u: int) -> bytes:
    return text if u == 1 else word_codes(text).tobytes()


def contexts(text: bytes, min_len: int = 400, k: int = K, u: int = 1):
    """(anchor place, first window, last window, anchor hash) of all contexts, in order; lengths and places in symbols of ``u`` bytes."""
    width, n_all = min_len - k + 1, len(text) // u
    for at in range(0, n_all - min_len + 1, _SEGMENT):
        x = np.frombuffer(text, np.uint8 if u == 1 else np.uint32, min(n_all - at, _SEGMENT + min_len - 1), at * u)
        h = _rolled(x, k)
        low = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        n = len(x) - min_len + 1
        low = np.minimum(low[:n], low[width - size : width - size + n])
        place = (low & np.uint64(_PLACE)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        p = place[first]
        yield p + at, first + at, last + at, (h[p] ^ np.uint64(u - 1)).view(np.int64)


def _anchors(min_len: int, n_words: int | None):
    names = ["doc_id", "th", "pos", "lo", "hi", "a", "c", "u"]
    kinds = [(1, min_len, K)] + ([(4, n_words, min(K_WORDS, n_words))] if n_words else [])

    def run(batches):
        for b in (part for x in batches for part in unit_bpe.slices(x, "text", 512)):
            out = [[] for _ in names]
            for doc_id, th, text in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist()):
                for u, n, k in kinds:
                    raw = symbols(text, u)
                    for pos, lo, hi, a in contexts(raw, n, k, u):
                        c = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e], o) for s, e, o in zip((lo * u).tolist(), ((hi + n) * u).tolist(), (pos - lo).tolist())), np.uint64, len(lo)).view(np.int64)
                        for col, v in zip(out, ([doc_id] * len(lo), np.full(len(lo), th), pos, lo, hi, a, c, np.full(len(lo), u))):
                            col.append(v)
            if out[0]:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                cols = [pa.array([x for part in out[0] for x in part], pa.int64()), *[pa.array(np.concatenate(v), t) for v, t in zip(out[1:], types)]]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def maximal_repeats(texts: list[bytes], starts: list[range], min_len: int, every: bool = True, owners: list | None = None):
    """(length, [(text, start), ...]) of the maximal repeats of at least ``min_len`` bytes.

    With ``owners`` (one for each text, None for many) those of more than one owner instead.

    The intervals of the common-prefix tree are visited bottom up by a stack over the sorted
    suffixes at ``starts``. With ``every`` each repeat has all its occurrences; without, an
    occurrence is named in its longest repeat only, which covers the same bytes.
    """
    suffixes = [(t, s) for t, r in enumerate(starts) for s in r]
    if not suffixes:
        return
    keys = [texts[t][s:] for t, s in suffixes]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    before = [owners[t] for t, _ in suffixes] if owners else [texts[t][s - 1] if s else -1 for t, s in suffixes]
    prefix = [_common(keys[i], keys[j]) if keys[i][:min_len] == keys[j][:min_len] else 0 for i, j in pairwise(order)]
    # an open interval: common length, first rank, bytes before (None: they differ), ranks not named yet
    stack: list[list] = []

    def closed(iv, end):
        length, first, left, waiting = iv
        if left is None:
            yield length, [suffixes[order[r]] for r in (range(first, end + 1) if every else waiting)]
            iv[3] = []

    def joined(x, y):
        return x if x == y and (owners or x != -1) else None

    for rank, length in enumerate([*prefix, 0]):
        carry = [0, rank, before[order[rank]], [rank]]
        while stack and stack[-1][0] > length:
            iv = stack.pop()
            iv[2] = joined(iv[2], carry[2]) if carry[2] is not None and iv[2] is not None else None
            iv[3] = iv[3] + carry[3]
            yield from closed(iv, rank)
            carry = iv
        if length >= min_len:
            if stack and stack[-1][0] == length:
                top = stack[-1]
                top[2] = joined(top[2], carry[2]) if carry[2] is not None and top[2] is not None else None
                top[3] = top[3] + carry[3]
            else:
                stack.append([length, carry[1], carry[2], carry[3]])


def _reach(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix that it has in common with another."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in pairwise(order):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _window_spans(texts: list[bytes], times: list[int], min_len: int):
    """Covered spans by hashes of all windows: for sets whose suffixes don't fit in memory."""
    h = [_rolled(np.frombuffer(t, np.uint8), min_len) for t in texts]
    values, back, counts = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, back, np.repeat(times, [len(x) for x in h]))
    at = 0
    for k, x in enumerate(h):
        for s in np.flatnonzero(total[back[at : at + len(x)]] > 1).tolist():
            yield k, s, s + min_len
        at += len(x)


def group_spans(group: list[tuple[int, int, int, bytes]], min_len: int) -> list[tuple[int, int, int]]:
    """(context, start, end) covered by repeats, from (context, occurrences, anchor offset, bytes) of one anchor.

    Each context is first cut to what it can have in common with another on either side of the
    anchor, and what is equal then is taken together.
    """
    left = _reach([b[:o][::-1] for _, _, o, b in group])
    right = _reach([b[o:] for _, _, o, b in group])
    cut: dict[tuple[int, bytes], list] = {}
    for (c, n, o, b), x, y in zip(group, left, right):
        x, y = (o, len(b) - o) if n > 1 else (x, y)
        if x + y >= min_len:
            e = cut.setdefault((x, b[o - x : o + y]), [0, []])
            e[0] += n
            e[1].append((c, o - x))
    whole, texts, times = list(cut.values()), [b for _, b in cut], [e[0] for e in cut.values()]
    if sum(len(b) - min_len + 1 for b in texts) > SUFFIXES and len(texts) > 1:
        found = _window_spans(texts, times, min_len)
    else:
        # What occurs more than once stands twice; the copy's first suffix shows that all of it repeats.
        double = [k for k, n in enumerate(times) if n > 1]
        own = len(texts) - len(double) > 0 and len(texts) > 1
        starts = [range(len(b) - min_len + 1) if own or n < 2 else range(1) for b, n in zip(texts, times)]
        twice = texts + [texts[k] for k in double]
        back = [*range(len(texts)), *double]
        found = ((back[t], s, s + n) for n, members in maximal_repeats(twice, starts + [range(1)] * len(double), min_len, every=False) for t, s in members)
    spans: dict[int, list] = {}
    for k, s, e in found:
        spans.setdefault(k, []).append((s, e))
    return [(c, s + shift, e + shift) for k, v in spans.items() for s, e in merged(v) for c, shift in whole[k][1]]


def group_passages(group: list[tuple[int, int | None, bytes]], n_words: int) -> list[tuple[int, int, int]]:
    """(context, start, end) in words covered by passages of more than one document, from (context, its document or None for many, symbols)."""
    owners, texts = [d for _, d, _ in group], [b for *_, b in group]
    size = 4 * n_words
    spans: dict[int, list] = {}
    if sum(len(b) - size + 4 for b in texts) > 4 * SUFFIXES:
        h = [_rolled(np.frombuffer(b, np.uint32), n_words) for b in texts]
        of: dict[int, int | None] = {}
        for x, d in zip(h, owners):
            for v in x.tolist():
                of[v] = d if of.get(v, d) == d else None
        for k, x in enumerate(h):
            spans[k] = [(s, s + n_words) for s, v in enumerate(x.tolist()) if of[v] is None]
    else:
        for n, members in maximal_repeats(texts, [range(0, len(b) - size + 1, 4) for b in texts], size, every=False, owners=owners):
            for t, s in members:
                spans.setdefault(t, []).append((s // 4, (s + n) // 4))
    return [(group[k][0], s, e) for k, v in spans.items() for s, e in merged(v)]


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _spans(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["a", "c", "s", "e"])


def _cut_out(min_len: int, n_words: int | None):
    """Symbols of contexts; an anchor's only context is resolved at once, with s and e filled."""
    kinds = [("a", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("u", pa.int32()), ("owner", pa.int64()), ("o", pa.int32()), ("bytes", pa.binary()), ("s", pa.int32()), ("e", pa.int32())]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = []
                for text, wanted in zip(b.column("text").slice(i, 64).to_pylist(), b.column("wanted").slice(i, 64).to_pylist()):
                    raw = {u: symbols(text, u) for u in {w["u"] for w in wanted}}
                    for w in wanted:
                        u = w["u"]
                        piece = raw[u][w["lo"] * u : (w["hi"] + (min_len if u == 1 else n_words)) * u]
                        o = w["pos"] - w["lo"]
                        if w["m"] > 1:
                            rows.append((w["a"], w["c"], w["n"], w["m"], u, w["owner"], o, piece, None, None))
                        else:
                            rows += [(w["a"], c, *[None] * 6, s, e) for c, s, e in group_spans([(w["c"], w["n"], o, piece)], min_len)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def _by_anchor(min_len: int, n_words: int | None):
    def resolved(a, u, held):
        if u == 1:
            return [(a, *x) for x in group_spans([(c, n, o, piece) for c, n, _, o, piece in held], min_len)]
        return [(a, *x) for x in group_passages([(c, owner, piece) for c, _, owner, _, piece in held], n_words)]

    def run(batches):
        key, held = None, []
        for b in batches:
            rows = []
            for a, u, *one in zip(*(b.column(x).to_pylist() for x in ("a", "u", "c", "n", "owner", "o", "bytes"))):
                if (a, u) != key:
                    if held:
                        rows += resolved(*key, held)
                    key, held = (a, u), []
                held.append(one)
            yield _spans(rows)
        if held:
            yield _spans(resolved(*key, held))

    return run


def _window_rows(min_len: int, n_words: int | None):
    def run(batches):
        for b in batches:
            for a, c, n, u, owner, piece in zip(*(b.column(x).to_pylist() for x in ("a", "c", "n", "u", "owner", "bytes"))):
                h = _rolled(np.frombuffer(piece, np.uint8 if u == 1 else np.uint32), min_len if u == 1 else n_words).view(np.int64)
                whole = [pa.array(np.full(len(h), x)) for x in (a, c, n)] + [pa.array([u] * len(h), pa.int32()), pa.array([owner] * len(h), pa.int64())]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(h), pa.array(np.arange(len(h), dtype=np.int32))], ["a", "c", "n", "u", "owner", "h", "s"])

    return run


def repeated_spans(docs: DataFrame, min_len: int = 400, n_words: int | None = None) -> DataFrame:
    """(doc_id, th, u, lo, hi): spans [lo, hi) covered by strings that also start elsewhere.

    u = 1: bytes covered by strings of ``min_len`` bytes, elsewhere in the same document
    included. u = 4 (with ``n_words``): words covered by strings of that many words, white space
    apart, that another document has too. th is the xxhash64 of the text, so that rows without
    or with the same doc_id are told apart; spans of a document may overlap.
    """
    texts = docs.select("doc_id", F.xxhash64(text_bytes()).alias("th"), text_bytes().alias("text"))
    least = min(min_len, 2 * n_words - 1) if n_words else min_len
    each = written(texts.filter(F.length("text") >= least).mapInArrow(_anchors(min_len, n_words), "doc_id long, th long, pos int, lo int, hi int, a long, c long, u int"), "repeat-anchors")
    own = F.xxhash64("doc_id", "th").alias("d")
    twice = (F.col("times") > 1) & ((F.col("u") == 1) | (F.col("first") != F.col("last")))
    often = written(each.select("a", "u", own).groupBy("a", "u").agg(F.count("*").alias("times"), F.min("d").alias("first"), F.max("d").alias("last")).filter(twice).select("a", "u"), "repeat-often")
    found = written(each.join(often, ["a", "u"]), "repeat-candidates")
    discard(each, often)
    kinds = found.withColumn("d", own).groupBy("a", "c", "u").agg(F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.min(F.struct("doc_id", "th", "pos", "lo", "hi")).alias("first"))
    kinds = written(kinds.withColumn("owner", F.when(F.col("d0") == F.col("d1"), F.col("d0"))).drop("d0", "d1"), "repeat-contexts")
    sizes = written(kinds.groupBy("a", "u").agg(F.count("*").alias("m"), F.count("owner").alias("single")).filter("u = 1 or (m > 1 and single > 0)"), "repeat-sizes")
    wanted = kinds.join(sizes, ["a", "u"]).select(F.col("first.doc_id").alias("id"), F.col("first.th").alias("h"), F.struct("a", "c", "n", "m", "u", "owner", "first.pos", "first.lo", "first.hi").alias("w"))
    wanted = wanted.groupBy("id", "h").agg(F.collect_list("w").alias("wanted"))  # of one text
    # Rows repeated whole give their pieces again; equal spans are taken together below.
    texts_of = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("text", "wanted")
    pieces = written(texts_of.mapInArrow(_cut_out(min_len, n_words), "a long, c long, n long, m long, u int, owner long, o int, bytes binary, s int, e int"), "repeat-pieces")
    spans = pieces.filter("m is null").select("a", "c", "s", "e")
    if n_words:  # a context of several documents is a passage as a whole
        spans = spans.union(kinds.filter("u = 4 and owner is null").select("a", "c", F.lit(0).alias("s"), (F.col("first.hi") - F.col("first.lo") + n_words).alias("e")))
    group = pieces.filter(f"m between 2 and {CONTEXTS}").select("a", "u", "c", "n", "owner", "o", "bytes").repartition("a").sortWithinPartitions("a", "u", "c")
    spans = spans.union(group.mapInArrow(_by_anchor(min_len, n_words), _SPAN))
    many = pieces.filter(f"m > {CONTEXTS}")
    if many.limit(1).count():
        rows = written(many.select("a", "c", "n", "u", "owner", "bytes").distinct().mapInArrow(_window_rows(min_len, n_words), "a long, c long, n long, u int, owner long, h long, s int"), "repeat-windows")
        counted = rows.groupBy("a", "u", "h").agg(F.sum("n").alias("times"), F.min("owner").alias("d0"), F.max("owner").alias("d1"), F.count_if(F.col("owner").isNull()).alias("many"))
        twice = written(counted.filter("if(u = 1, times > 1, many > 0 or d0 <> d1)").select("a", "u", "h"), "repeat-windows-often")
        spans = spans.union(rows.join(twice, ["a", "u", "h"]).select("a", "c", "s", (F.col("s") + F.when(F.col("u") == 1, min_len).otherwise(n_words)).alias("e")))
    spans = written(spans.distinct(), "repeat-spans")
    discard(kinds, sizes, pieces)
    return found.join(spans, ["a", "c"]).select("doc_id", "th", "u", (F.col("lo") + F.col("s")).alias("lo"), (F.col("lo") + F.col("e")).alias("hi"))


def _removed(batches):
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_repeated_words": pa.int64(), "kept": pa.binary()}
    for b in (part for x in batches for part in unit_bpe.slices(x, "text", 512)):
        out = []
        for doc_id, text, spans, words in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans", "words"))):
            cuts = merged((s["lo"], s["hi"]) for s in spans or ())
            kept, at = [], 0
            for s, e in cuts:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            kept = b"".join(kept)
            repeated = sum(e - s for s, e in merged((s["lo"], s["hi"]) for s in words or ()))
            out.append((doc_id, len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), repeated, kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))


def without_repeats(docs: DataFrame, min_len: int = 400, n_words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words, kept (the remaining bytes) for every row.

    Strings of ``min_len`` bytes are judged on the input, in the same document too; matches
    never cross documents. n_repeated_words counts the words in passages of ``n_words`` words or
    more, of whatever length in bytes, that another document has too; they stay where they are.
    A null text is empty and, as any text that is too short, loses nothing. Repeated rows are
    copies of each other, but only rows that differ in doc_id or text are other documents. An
    empty table gives an empty result; other columns are ignored.
    """
    place = F.struct("lo", "hi")
    spans = repeated_spans(docs, min_len, n_words).groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h"))
    spans = spans.agg(F.collect_set(F.when(F.col("u") == 1, place)).alias("spans"), F.collect_set(F.when(F.col("u") == 4, place)).alias("words"))
    texts = docs.select("doc_id", F.xxhash64(text_bytes()).alias("th"), text_bytes().alias("text"))
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "spans", "words")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long, kept binary")
