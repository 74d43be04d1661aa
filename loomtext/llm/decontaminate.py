"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` word positions; words under a 0 are ignored, so a window
matches in spite of substitutions there. Windows of documents and benchmark items with equal
seed hashes are aligned, and the aligned words are compared: some window of them has to hold
``min_words`` matching words, or 0.8 of an item that is shorter, at an identity of 0.8 or more.
Such a window always has a run of a few matching words, whose length follows from the rule; such
runs are seeds too, so that no window is missed for want of one. Items of fewer than
``LEAST_ITEM`` words are no evidence of anything and match nothing; ``short_items`` lists them.

Test and training hashes are joined in one of two ways with the same results. A benchmark of up
to ``block_bytes`` is sent to the executors as sorted hash tables. A larger one is joined as a
table: documents send the seeds that pass a bitmap of fixed size, aligned pieces go to the items.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unit_bpe
from .common import written

#: Masks over 12 words; 7 or 8 of them are compared.
SEEDS = ("111010010111", "110110011011", "101101101101", "111111100000", "000001111111")
SPAN = len(SEEDS[0])
LEAST_ITEM = 8
_SEPARATE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_FOUND = {"item_id": pa.int64(), "at": pa.int32(), "words": pa.int32(), "matched": pa.int32(), "coverage": pa.float64()}
_ROW = "item_id long, at int, words int, matched int, coverage double"
#: Aligned (item, diagonal) pairs that are unfolded at once from the hits of a document.
_PAIRS = 1 << 20
#: Bits of the bitmap of test seeds, whatever the size of the benchmark: 16 MB in buckets of 4 kB.
_BITS = 1 << 27


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of letters, digits and any character beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def least_of(n: int, min_words: int) -> int:
    """Matching words that an overlap with an item of ``n`` words needs."""
    return min(min_words, math.ceil(0.8 * n))


@lru_cache(maxsize=4096)
def run_of(n: int, min_words: int) -> int:
    """The longest run of matches that every accepted window of an item of ``n`` words holds: x substitutions leave x + 1 runs."""
    least = least_of(n, min_words)
    return min(-(-m // (min(m // 4, n - m) + 1)) for m in range(least, min(n, least + 4) + 1))  # more matches hold no shorter runs


_MASKS = sorted({tuple(i for i, c in enumerate(s) if c == "1") for s in SEEDS})


def seeds_of(n: int, min_words: int) -> list[tuple[tuple[int, ...], int]]:
    """(places compared, span) of the seeds for an item of ``n`` words: the masks, where they fit, and the run."""
    run = run_of(n, min_words)
    return [(m, SPAN) for m in _MASKS if n >= SPAN] + [(tuple(range(run)), run)]


def hashes(ids: np.ndarray, where: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = np.full(len(where), len(mask) * 131 + mask[-1], np.uint64)
    for m in mask:
        h = (h ^ ids[where + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def overlap(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, end, matches) of the window of identity 0.8 or more with the most matches, at least ``least`` of them."""
    if np.count_nonzero(same) < least:
        return None
    # At 1 for a match and -4 for a substitution, windows of an identity of 0.8 are those that sum to 0 or more.
    score, hits_to = (np.concatenate(([0], np.cumsum(x))) for x in (np.where(same, 1, -4), same))
    starts = np.searchsorted(-np.minimum.accumulate(score), -score, "left")  # the earliest for each end has the most matches
    end = int(np.argmax(hits_to - hits_to[starts]))
    start = int(starts[end])
    matched = int(hits_to[end] - hits_to[start])
    return (start + int(np.argmax(same[start:end])), end, matched) if matched >= least else None


class SeedIndex:
    """Seed hashes of benchmark items; windows are looked up by sorted search, hits verified word by word."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 13):
        self.min_words, self.vocab, self.items = min_words, {}, []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= LEAST_ITEM:
                self.items.append((item_id, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64)))
        found: dict[tuple, list] = {}
        for k, (_, ids) in enumerate(self.items):
            for mask, span in seeds_of(len(ids), min_words):
                where = np.arange(len(ids) - span + 1)
                found.setdefault((mask, span), []).append((hashes(ids, where, mask), np.stack([np.full(len(where), k), where], 1)))
        self.tables = []
        for seed, parts in sorted(found.items()):
            h, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.tables.append((*seed, h[order], at[order]))

    def _diagonals(self, ids: np.ndarray) -> np.ndarray:
        """(item, diagonal) of all seed hits, each once; hits of a seed that many items share are unfolded in slices."""
        known, found = ids > 0, []
        for mask, span, h, at in self.tables:
            m = len(ids) - span + 1
            if m < 1:
                continue
            all_known = known[mask[0] : mask[0] + m].copy()
            for k in mask[1:]:
                all_known &= known[k : k + m]
            where = np.flatnonzero(all_known)
            own = hashes(ids, where, mask)
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            hit = np.flatnonzero(hi > lo)
            sizes = np.cumsum(hi[hit] - lo[hit])
            for part in np.split(hit, np.flatnonzero(np.diff(sizes // _PAIRS)) + 1) if len(hit) else ():
                n = hi[part] - lo[part]
                first = np.cumsum(n) - n
                rows = at[np.repeat(lo[part] - first, n) + np.arange(n.sum())]
                found.append(np.unique(np.stack([rows[:, 0], np.repeat(where[part], n) - rows[:, 1]], 1), axis=0))
                if sum(map(len, found)) > 4 * _PAIRS:
                    found = [np.unique(np.concatenate(found), axis=0)]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def find(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, words, matching words, share of the item) of the best overlap with each item."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, [0] * len(words)), np.uint64, len(words))
        best: dict[int, tuple] = {}
        for k, shift in self._diagonals(ids).tolist():
            item_id, item = self.items[k]
            a, b = max(0, shift), min(len(ids), shift + len(item))
            least = max(least_of(len(item), self.min_words), best.get(item_id, (0, 0, 0))[2] + 1)
            if found := overlap(ids[a:b] == item[a - shift : b - shift], least):
                start, end, matched = found
                best[item_id] = (a + start, end - start, matched, matched / len(item))
        return [(i, *x) for i, x in sorted(best.items())]


# ---- small benchmarks: hash tables on the executors
def _small(benchmark: DataFrame, min_words: int, block_bytes: int) -> SeedIndex | None:
    """The index of a benchmark of up to ``block_bytes`` of text; None for a larger one."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return SeedIndex(sorted((tuple(r) for r in rows.collect()), key=lambda x: (x[0] is None, x)), min_words) if size <= block_bytes else None


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


# ---- larger benchmarks: seeds as a table
def _numbers(words: list[bytes], memory: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; the memory starts anew beyond a bound."""
    if len(memory) > 200_000:
        memory.clear()
    for w in words:
        if w not in memory:
            memory[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def _item_seeds(min_words: int):
    kinds = {"h": pa.int64(), "ikey": pa.string(), "n": pa.int32(), "off": pa.int32()}

    def run(batches):
        memory: dict[bytes, int] = {}
        for b in batches:
            for ikey, text in zip(b.column("ikey").to_pylist(), b.column("text").to_pylist()):
                ids = _numbers(words_of(text), memory)
                for mask, span in seeds_of(len(ids), min_words) if len(ids) >= LEAST_ITEM else ():
                    where = np.arange(len(ids) - span + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes(ids, where, mask).view(np.int64)), pa.array([ikey] * len(where)), pa.array(np.full(len(where), len(ids), np.int32)), pa.array(where.astype(np.int32))], list(kinds))

    return run


def _doc_seeds(bitmap, seeds):
    """(key, h, at) of the windows whose hash is in the bitmap."""

    def run(batches):
        memory: dict[bytes, int] = {}
        bits = np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            for b in unit_bpe.slices(whole, "text", 512):
                for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                    ids = _numbers(words_of(text), memory)
                    for mask, span in seeds:
                        h = hashes(ids, np.arange(max(0, len(ids) - span + 1)), mask)
                        place = h & np.uint64(_BITS - 1)
                        at = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                        for i in range(0, len(at), _PAIRS):
                            part = at[i : i + _PAIRS]
                            yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(h[part].view(np.int64)), pa.array(part.astype(np.int32))], ["key", "h", "at"])

    return run


def _pieces(batches):
    """The words of a document that lie along each of its diagonals."""
    kinds = {"key": pa.string(), "ikey": pa.string(), "shift": pa.int32(), "piece": pa.binary()}
    for b in batches:
        for key, text, wanted in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            words = words_of(text)
            for i in range(0, len(wanted), 1024):
                yield _batch([(key, w["ikey"], w["shift"], b" ".join(words[max(0, w["shift"]) : w["shift"] + w["n"]])) for w in wanted[i : i + 1024]], kinds)


def _verify(min_words: int):
    def run(batches):
        for b in batches:
            out = []
            for key, item_id, shift, piece, text in zip(*(b.column(c).to_pylist() for c in ("key", "item_id", "shift", "piece", "text"))):
                item, own = words_of(text), piece.split()
                skip = max(0, -shift)
                same = np.fromiter((x == y for x, y in zip(own, item[skip:])), bool, min(len(own), len(item) - skip))
                if found := overlap(same, least_of(len(item), min_words)):
                    start, end, matched = found
                    out.append((key, item_id, max(0, shift) + start, end - start, matched, matched / len(item)))
            yield _batch(out, {"key": pa.string()} | _FOUND)

    return run


def _joined(keyed: DataFrame, benchmark: DataFrame, min_words: int) -> DataFrame:
    """(key, item_id, at, words, matched, coverage) by a join of seed hashes, for (key, text) with one row for each key."""
    spark = keyed.sparkSession
    items = written(benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct().withColumn("ikey", F.md5(F.concat_ws("\n", F.col("item_id").cast("string"), "text").cast("binary"))), "seed-items")
    seeds = written(items.select("ikey", "text").mapInArrow(_item_seeds(min_words), "h long, ikey string, n int, off int"), "seeds")
    place = F.col("h").bitwiseAND(F.lit(_BITS - 1)) + 1  # bitmap positions count from 1
    buckets = seeds.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()  # at most _BITS / 32768 rows
    bitmap = bytearray(_BITS // 8)
    for r in buckets:
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    every = sorted({s for n in range(LEAST_ITEM, 8 * min_words) for s in seeds_of(n, min_words)})  # longer items have no other runs
    found = keyed.mapInArrow(_doc_seeds(spark.sparkContext.broadcast(bytes(bitmap)), every), "key string, h long, at int")
    found = written(found, "seed-hits")
    pairs = found.join(seeds, "h").select("key", "ikey", "n", (F.col("at") - F.col("off")).alias("shift")).distinct()
    wanted = written(pairs.groupBy("key").agg(F.collect_list(F.struct("ikey", "n", "shift")).alias("wanted")), "seed-wanted")  # of one text
    pieces = written(keyed.join(wanted, "key").mapInArrow(_pieces, "key string, ikey string, shift int, piece binary"), "seed-pieces")
    overlaps = pieces.join(items, "ikey").select("key", "item_id", "shift", "piece", "text").mapInArrow(_verify(min_words), "key string, " + _ROW)
    best = overlaps.groupBy("key", "item_id").agg(F.max(F.struct("matched", -F.col("at"), -F.col("words"), "coverage")).alias("m"))
    return written(best.select("key", "item_id", (-F.col("m").getField("col2")).alias("at"), (-F.col("m").getField("col3")).alias("words"), "m.matched", "m.coverage"), "seed-overlaps")


def _keyed(docs: DataFrame) -> DataFrame:
    """One row for each distinct text."""
    return docs.filter("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key"), "text").dropDuplicates(["key"])


def short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of the items that are too short to be looked for; null texts too."""
    separate = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")
    return benchmark.select("item_id", "text").filter(F.col("text").isNull() | (F.size(F.filter(separate, lambda w: w != "")) < LEAST_ITEM))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, at, words, matched, coverage): the best overlap of each document with each item it contains.

    Only overlaps that pass are returned; of equally good ones the first in the text. Null and
    empty texts, of documents or items, and items of fewer than ``LEAST_ITEM`` words overlap
    with nothing; repeated rows give their rows again, items that share an id count as one. An
    empty table gives an empty result; other columns are ignored. Only a benchmark of up to
    ``block_bytes`` is sent to the executors; a larger one is joined.
    """
    index = _small(benchmark, min_words, block_bytes)
    if index is None:
        found = _joined(_keyed(docs), benchmark, min_words)
        return docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).join(found, "key").select("doc_id", *_FOUND)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for whole in batches:
            for b in unit_bpe.slices(whole, "text", 512):
                yield _batch([(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for x in sent.value.find(t)], {"doc_id": pa.int64()} | _FOUND)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + _ROW)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each contaminated document: doc_id, n_items, item_ids (ascending), coverage (the largest)."""
    found = contaminated(docs, benchmark, **options)
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all columns, that overlap with no benchmark item; see ``contaminated``."""
    index = _small(benchmark, min_words, block_bytes)
    if index is None:
        gone = _joined(_keyed(docs), benchmark, min_words).select(F.col("key").alias("__key")).distinct()
        return docs.join(gone, F.md5(F.col("text").cast("binary")) == F.col("__key"), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        unit_bpe.forget()
        for whole in batches:
            for b in unit_bpe.slices(whole, "text", 512):
                yield b.filter(pa.array([not sent.value.find(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
