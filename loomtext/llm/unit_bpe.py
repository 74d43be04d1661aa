"""Exact sub-word encoding with memory: the library encodes each distinct unit once per worker.

Both vocabularies split a text into pieces before any merge, and no piece crosses white space
(the byte-level one: a single space always opens the next piece). A text is therefore the
concatenation of its space-separated units, each of which the library has to see only once.
Texts in which this argument could fail (other white space, special strings, runs of spaces)
go to the library whole.
"""

from __future__ import annotations

import array
import re
import unicodedata
import weakref
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points below this bound are assigned, stable under NFC and have plain lower-case forms.
_BOUND = 0x250
_CAP = 500_000


def _classes() -> tuple[str, str]:
    kinds = {k: "".join(c for c in map(chr, range(0x21, _BOUND)) if unicodedata.category(c)[0] == k) for k in "LN"}
    return kinds["L"], kinds["N"]


_L, _N = _classes()
_SIMPLE = re.compile(r"[\x21-\x7e¡-įı-ɏ]+")
#: RE2: other white space than single spaces and line breaks, special strings, a blank at either end, nothing at all.
_ODD_SPACE = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n|<\||\A[ \n]|[ \n]\z|\A\z"
_HARD = re.compile("[\x1c-\x1f\x85]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Memory(dict):
    """A dict that computes what it lacks and starts anew beyond ``_CAP`` entries (bounded memory)."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= _CAP:
            self.clear()
        value = self[key] = self.make(key)
        return value


class UnitCounter:
    """Token counts for a vocabulary that lower-cases and drops white space."""

    pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.piece = _Memory(lambda p: len(self.lib.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))))
        self.unit = _Memory(self._unit)

    def whole(self, text: str) -> int:
        return len(self.lib.encode(text, add_special_tokens=False))

    def _unit(self, u: str) -> int:
        if _SIMPLE.fullmatch(u):
            return sum(map(self.piece.__getitem__, self.pieces.findall(u.lower())))
        return self.whole(u)

    def count(self, text: str) -> int:
        if _HARD.search(text):
            return self.whole(text)
        return sum(map(self.unit.__getitem__, text.split()))


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit integers for a byte-level vocabulary.

    The distinct units of a batch are looked up once each; their ids stand end to end in one
    array, from which those of the texts are gathered.
    """

    pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.piece = _Memory(self._piece)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0

    def whole(self, text: str) -> bytes:
        return array.array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, p: str) -> tuple[int, ...]:
        return tuple(t.id for t in self.lib.model.tokenize(p.encode().decode("latin-1").translate(_LETTERS)))

    def _units(self, units: list[str]) -> tuple[list[int], list[int]]:
        """Ids, and where they end, of units after a space, that start with their line break, or (marked by a space before them) come first in a text."""
        ids, ends, tokenize = [], [], self.lib.model.tokenize
        for u in units:
            core = u.rstrip(".,;:!?")
            if core.isalpha() and (core.isascii() or _SIMPLE.fullmatch(core)):  # one piece with its space, then one of marks
                ids += [t.id for t in tokenize("Ġ" + (core if core.isascii() else core.encode().decode("latin-1").translate(_LETTERS)))]
                if len(core) < len(u):
                    ids += self.piece[u[len(core) :]]
            elif u[:1] == " ":
                ids += self.lib.encode(u[1:], add_special_tokens=False).ids
            else:
                text = u if u[:1] == "\n" else " " + u
                if _SIMPLE.fullmatch(text, 1):
                    for p in self.pieces.findall(text):
                        ids += self.piece[p]
                else:
                    ids += self.lib.encode(text, add_special_tokens=False).ids
            ends.append(len(ids))
        return ids, ends

    def _rows(self, units: list[str]) -> np.ndarray:
        """Rows in ``start`` and ``size`` of distinct units; those that are not known are encoded."""
        rows = np.fromiter(map(self.at.get, units, repeat(-1)), np.int32, len(units))
        new = [units[i] for i in np.flatnonzero(rows < 0)]
        if new:
            ids, ends = self._units(new)
            first, total, ends = len(self.at), self.used + len(ids), np.array(ends, np.int64)
            self.at.update(zip(new, range(first, first + len(new))))
            while len(self.start) < first + len(new):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            if len(self.ids) < total:
                self.ids = np.concatenate([self.ids, np.zeros(max(total - len(self.ids), len(self.ids)), np.uint32)])
            starts = np.concatenate(([0], ends[:-1]))
            self.start[first : first + len(new)], self.size[first : first + len(new)] = self.used + starts, ends - starts
            self.ids[self.used : total] = ids
            self.used = total
            rows[rows < 0] = np.arange(first, first + len(new))
        return rows

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of an array without nulls."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        if len(self.at) > _CAP:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts if len(plain) == len(texts) else texts.take(pa.array(plain)), "\n", " \n"), " ")
        ends, firsts = lists.offsets.to_numpy(), lists.values.take(lists.offsets.slice(0, len(lists))).dictionary_encode()
        units = lists.values.dictionary_encode()
        del lists
        rows = self._rows(units.dictionary.to_pylist())[units.indices.to_numpy()]
        del units
        rows[ends[:-1]] = self._rows([" " + u for u in firsts.dictionary.to_pylist()])[firsts.indices.to_numpy()]
        sizes = self.size[rows]
        stops = np.cumsum(sizes, dtype=np.int64)
        kind = np.int32 if max(self.used, stops[-1]) < 1 << 31 else np.int64
        at = np.repeat((self.start[rows] - (stops - sizes)).astype(kind), sizes)
        at += np.arange(stops[-1], dtype=kind)
        ids = self.ids[at].tobytes()
        cuts = (4 * np.concatenate((stops[ends[:-1]] - sizes[ends[:-1]], stops[-1:]))).tolist()
        for k, i in enumerate(plain.tolist()):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=4)
def counter(path: str) -> UnitCounter:
    return UnitCounter(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def slices(batch: pa.RecordBatch, column: str, rows: int = 8192, size: int = 6 << 20):
    """Parts of a batch of about ``size`` bytes of a text or binary column, which bounds what is held of it."""
    used = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = used[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(used, before + size, "right")) - at))
        yield batch.slice(at, n)
        at += n


#: What workers that are used again remember beside the tokenizers: objects with a ``_forget``.
HELD: "weakref.WeakSet" = weakref.WeakSet()


def forget(keep=None) -> None:
    """Frees what a reused worker remembers of other operators; each calls it when its task begins, and names its own."""
    for x in list(HELD):
        if x is not keep:
            x._forget()
    for cache in (counter, encoder):
        if not (keep is not None and cache.cache_info().currsize and isinstance(keep, (UnitCounter, UnitEncoder)) and isinstance(keep, UnitCounter) == (cache is counter)):
            cache.cache_clear()
    pa.default_memory_pool().release_unused()
