"""Token ids in sorted-string-table shards.

File: magic, data blocks, block index, Bloom filter, footer. A data block holds entries in key
order, each key stored as the length it shares with the key before it and the rest; blocks are
compressed one by one. The index has each block's first key, offset and size, so that a lookup
is a Bloom test, a binary search in the index and a scan of one block. The footer has the
places of index and filter, the counts and a checksum.

Entry: key = the order number as 8 big-endian bytes with the sign bit flipped (no bytes for a
null); value = a flag byte, the document's id (8 bytes) and its token ids as little-endian
unsigned 32-bit integers.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import unit_bpe
from .common import scratch, written

MAGIC = b"LTSST01\n"
_FOOT = struct.Struct("<QQQQQQI8s")  # index at, index size, bloom at, bloom size, entries, tokens, crc of index + bloom, magic
_MANIFEST = "path string, part int, n_docs long, n_tokens long, n_bytes long, first_key binary, last_key binary"
_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(number: int | None) -> bytes:
    return b"" if number is None else struct.pack(">Q", (number + (1 << 63)) & (1 << 64) - 1)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int, k: int = 7) -> np.ndarray:
    h = np.array([zlib.crc32(x) | zlib.crc32(x, 0x9E3779B9) << 32 for x in keys], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class ShardWriter:
    """Writes entries that arrive in key order; memory: one block, the index and 8 bytes a key."""

    def __init__(self, sink, block_bytes: int = 1 << 18):
        self.sink, self.block_bytes = sink, block_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at, self.block, self.size, self.last, self.first = 0, [], 0, b"", None
        self.index, self.keys, self.entries, self.tokens = [], [], 0, 0
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.sink.write(b)
        self.at += len(b)

    def _flush(self) -> None:
        if self.block:
            packed = self.zip.compress(b"".join(self.block))
            self.index.append(_varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(packed)))
            self._put(packed)
            self.block, self.size, self.last, self.first = [], 0, b"", None

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        rest = key[shared:]
        self.block += [_varint(shared), _varint(len(rest)), _varint(len(value)), rest, value]
        self.size += len(value) + 16
        self.last = key
        self.keys.append(key)
        self.entries, self.tokens = self.entries + 1, self.tokens + tokens
        if self.size >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        bits = max(64, 10 * len(self.keys) + 7 >> 3 << 3)
        filled = np.zeros(bits, bool)
        if self.keys:
            filled[_bloom_places(self.keys, bits).ravel()] = True
        index, bloom = _varint(len(self.index)) + b"".join(self.index), np.packbits(filled).tobytes()
        index_at = self.at
        self._put(index)
        bloom_at = self.at
        self._put(bloom)
        self._put(_FOOT.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.tokens, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))
        self.sink.close()


class ShardReader:
    """Reads a shard block by block, or one key by Bloom test and binary search."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        ix_at, ix_n, bl_at, bl_n, self.entries, self.tokens, crc, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        index, self.bloom = self.file.read_at(ix_n, ix_at), self.file.read_at(bl_n, bl_at)
        if magic != MAGIC or zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError(f"{path} is not a whole shard")
        n, at = _read_varint(index, 0)
        self.blocks = []
        for _ in range(n):
            k, at = _read_varint(index, at)
            key, at = index[at : at + k], at + k
            place, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.blocks.append((key, place, length))

    def entries_of(self, block: int):
        _, place, length = self.blocks[block]
        b = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, place))
        at, key = 0, b""
        while at < len(b):
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            n, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            yield key, memoryview(b)[at + rest : at + rest + n]
            at += rest + n

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.entries_of(i)

    def get(self, key: bytes) -> list[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every entry with this key."""
        bits = np.unpackbits(np.frombuffer(self.bloom, np.uint8))
        if not bits[_bloom_places([key], len(bits)).ravel()].all():
            return []
        firsts, found = [b[0] for b in self.blocks], []
        for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            found += [unpack(v) for k, v in self.entries_of(i) if k == key]
        return found


def unpack(value) -> tuple[int | None, np.ndarray]:
    return (struct.unpack_from("<q", value, 1)[0] if value[0] else None), np.frombuffer(value[9:], "<u4")


def _write(folder: str, tokenizer_path: str, end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        enc, w = unit_bpe.encoder(tokenizer_path), None
        unit_bpe.forget(enc)
        for b in (part for x in batches for part in unit_bpe.slices(x, "text")):
            for number, doc_id, ids in zip(b.column("number").to_pylist(), b.column("doc_id").to_pylist(), enc.encode_all(b.column("text"))):
                if w is None:
                    path = f"{folder}/shard-{uuid.uuid4().hex}.sst"  # only the shards of tasks that ended well get into the manifest
                    where, name = fs.FileSystem.from_uri(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    w, first = ShardWriter(where.open_output_stream(name)), key_of(number)
                ids += end
                w.add(key := key_of(number), (b"\0" * 9 if doc_id is None else b"\1" + struct.pack("<q", doc_id)) + ids, len(ids) // 4)
        if w is not None:
            w.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "part": TaskContext.get().partitionId(), "n_docs": w.entries, "n_tokens": w.tokens, "n_bytes": w.at, "first_key": first, "last_key": key}], pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]))

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Encodes ``docs`` (number, doc_id, text) and writes shards in the order of ``number``; returns the manifest.

    One shard for each range of numbers. A null number sorts first, a null text is empty, rows
    with the same number stay together in the order of their text. A task that is run again
    writes a new file; the manifest, written by Spark's committer, names whole files only.
    """
    folder = folder or scratch(docs.sparkSession, "shards")
    ranged = docs.select("number", "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("number").sortWithinPartitions("number", "doc_id", "text")
    return written(ranged.mapInArrow(_write(folder, tokenizer_path, end_id), _MANIFEST), "shard-manifest")


def in_written_order(docs: DataFrame) -> DataFrame:
    """number, doc_id, text: rows of a Parquet table numbered by its files (part and chunk number) and the rows in them.

    A table that is no direct file scan is written first, in the order of its partitions and
    their rows. A file's part number has 20 bits, its chunk 15, its rows 28; more is an error.
    """
    place = [F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")]
    try:
        placed = docs.select("doc_id", "text", *place)
    except AnalysisException:
        placed = written(docs.select("doc_id", "text"), "shard-order").select("doc_id", "text", *place)
    part, chunk = (F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(f, '{p}', 1), '') as long)"), F.lit(0)) for p in (r"part-([0-9]+)", r"-c([0-9]+)[.]"))
    fits = (part < 1 << 20) & (chunk < 1 << 15) & (F.col("r") < 1 << 28)
    number = F.when(fits, F.shiftleft(part, 43) + F.shiftleft(chunk, 28) + F.col("r")).otherwise(F.raise_error(F.lit("too many files or rows to number")).cast("long"))
    return placed.select(number.alias("number"), "doc_id", "text")


def _read(batches):
    for b in batches:
        for r in b.to_pylist():
            out, start = [], r["shard_start"]
            for _, value in ShardReader(r["path"]):
                doc_id, ids = unpack(value)
                out.append((doc_id, start, len(ids), zlib.crc32(value[9:])))
                start += len(ids)
            doc_id, starts, n, crc = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_id, starts, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; start counts the ids before it in key order."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("first_key", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("shard_start", before).select("path", "shard_start")  # a row for each shard
    return shards.repartition(max(1, manifest.count())).mapInArrow(_read, _ROW)
