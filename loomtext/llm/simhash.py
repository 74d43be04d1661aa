"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit gets a vector of radius + 1 bits. For each nonzero vector v, the mask of
the bits whose vector has an odd number of ones in common with v makes one table; its key is
the fingerprint under the mask. The vectors of any ``radius`` differing bits leave some v with
which all of them have even products, so two fingerprints within the radius agree on that
table's whole key: no link is missed. Candidates are verified by their exact distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unit_bpe
from .common import discard, text_bytes, written
from .graph import components

#: A key's group up to this size is scanned in memory; larger ones are linked through midpoints.
GROUP = 4096


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, lower case; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    h = np.fromiter([one(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int, seed: int):
    def run(batches):
        unit_bpe.forget()
        for whole in batches:
            for b in unit_bpe.slices(whole, "text", 512):
                fp = np.array([fingerprint(t, width, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits; bit i has the vector 1 + i mod (2^(radius+1) - 1)."""
    n = (1 << radius + 1) - 1
    return [sum(((1 + i % n) & v).bit_count() % 2 << i for i in range(bits)) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected within the radius: at most one less than the members."""
    out, left = [], np.arange(1, len(fp))
    queue = [0]
    while len(left):
        at = queue.pop() if queue else None
        if at is None:
            at, left = left[0], left[1:]
        near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
        if near.any():
            found = left[near].tolist()
            out += [(at, x) for x in found]
            queue += found
            left = left[~near]
    return out


def _links(radius: int):
    def rows(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def group(fp: np.ndarray):
        """A link has both ends; a member of a group too large to hold has only one."""
        pairs = np.array(_forest(fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return fp[pairs[:, 0]], fp[pairs[:, 1]]

    def run(batches):
        held, key, large = [], None, False  # of the group that may go on in the next batch

        def flush():
            if not large and held and len(fp := np.concatenate(held)) > 1:
                yield rows(*group(fp))

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(c).to_numpy() for c in ("t", "k", "fp"))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
            for s, e, last in zip(starts, ends, [*[False] * (len(starts) - 1), True]) if len(starts) < 3 else [(starts[0], ends[0], False)]:
                if (t[s], k[s]) != key:
                    yield from flush()
                    held, key, large = [], (t[s], k[s]), False
                held.append(fp[s:e])
                if large or sum(map(len, held)) > GROUP:
                    large, gone = True, np.concatenate(held)
                    held = []
                    yield rows(gone, [None] * len(gone))
            if len(starts) < 3:
                continue
            yield from flush()
            s, n = starts[1:-1], (ends - starts)[1:-1]
            two = s[n == 2]
            near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
            yield rows(fp[near], fp[near + 1])
            for at, size in zip(s[n > 2], n[n > 2]):
                if size > GROUP:
                    yield rows(fp[at : at + size], [None] * size)
                else:
                    yield rows(*group(fp[at : at + size]))
            held, key, large = [fp[starts[-1] :].copy()], (t[starts[-1]], k[starts[-1]]), False
            if len(held[0]) > GROUP:
                large, gone, held = True, held[0], []
                yield rows(gone, [None] * len(gone))
        yield from flush()

    return run


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all pairs within the radius.

    A group of more than ``GROUP`` fingerprints under one key is not scanned pair by pair: two
    fingerprints are within 2r of each other exactly if some 64-bit word is within r of both,
    so each member is written under all words within half the radius, and those under one
    word are linked to the smallest. That is linear in the members and misses nothing.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(covering_masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    found = written(keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_links(radius), "a long, b long"), "near-links")
    links, large = found.filter("b is not null"), found.filter("b is null").select("a").distinct()
    if large.limit(1).count():
        half = (radius + 1) // 2  # an odd radius: the words may be nearer to one end; links are verified below
        ball = [_signed(sum(1 << i for i in c)) for n in range(half + 1) for c in combinations(range(64), n)]
        words = large.select("a", F.explode(F.transform(F.array(*map(F.lit, ball)), lambda x: x.bitwiseXOR(F.col("a")))).alias("w"))
        low = written(words.groupBy("w").agg(F.min("a").alias("b")), "midpoints")
        links = links.union(words.join(low, "w").filter("a <> b").select("a", "b").distinct())
        if radius % 2:
            raise ValueError("groups this large need an even radius")
    return links


def _groups(first: DataFrame, radius: int) -> DataFrame:
    """(of, best): for each fingerprint of (fp, first) the least ``first`` of those that it is linked to, directly or not.

    Links and components are of fingerprints, so that rows with the same id stay apart.
    """
    roots = components(near_links(first.select("fp"), radius))
    of = written(first.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first", F.coalesce("root", "fp").alias("component")), "fingerprint-groups")
    least = written(of.groupBy("component").agg(F.min("first").alias("best")), "fingerprint-least")
    out = written(of.join(least, "component").select(F.col("fp").alias("of"), "best"), "fingerprint-components")
    discard(roots, of, least)
    return out


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row.

    A null or blank text has fingerprint zero and is linked like any other. A row without
    doc_id has a fingerprint, but no links and a null component. Repeated rows are in one
    component; rows that share a doc_id only are linked by their texts alone. An empty table
    gives an empty result; other columns are ignored.
    """
    each = written(fingerprints(docs, width, seed), "fingerprints")
    first = written(each.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    return each.join(_groups(first, radius), F.col("fp") == F.col("of"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("best")).alias("component_id")
    )


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates in ``docs``: that of the smallest doc_id; rows without doc_id stay.

    Rows are told apart by doc_id and a hash of all their columns. Of rows that share an id,
    those that are near-duplicates leave one (that of the least hash), the others all stay.
    Rows repeated whole leave one. Null and blank texts are near-duplicates of each other. An
    empty table gives an empty result; all columns are returned.
    """
    tagged = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    each = tagged.filter("doc_id is not null").select("doc_id", "__row", text_bytes().alias("text"))
    each = written(each.mapInArrow(_fingerprints(width, seed), "doc_id long, __row long, fp long"), "keep-rows")
    first = written(each.groupBy("fp").agg(F.min(F.struct("doc_id", "__row")).alias("first")), "keep-first")
    rest = each.join(_groups(first, radius), F.col("fp") == F.col("of")).filter((F.col("doc_id") != F.col("best.doc_id")) | (F.col("__row") != F.col("best.__row")))
    gone = written(rest.select("doc_id", "__row").distinct(), "near-copies")
    if each.groupBy("doc_id", "__row").count().filter("count > 1").limit(1).count():  # rows repeated whole
        tagged = tagged.filter("doc_id is not null").dropDuplicates(["doc_id", "__row"]).union(tagged.filter("doc_id is null"))
    return tagged.join(gone.hint("merge"), ["doc_id", "__row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
