"""Subword merges learnt from word counts, and a word-level vocabulary as the baseline."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import pretokenize
from ..session import discard, scratch

END = "</w>"
UNKNOWN, END_OF_TEXT = "<|unk|>", "<|endoftext|>"


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(pretokenize(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def top_pair(counts: DataFrame) -> DataFrame:
    """(a, b, count) of the first merge: the commonest pair of neighbouring symbols, ties by the pair."""
    symbols = F.concat(F.split("word", ""), F.array(F.lit(END)))
    symbols = F.filter(symbols, lambda x: x != "")
    pairs = counts.select("count", symbols.alias("s")).select("count", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("a"), F.element_at("s", i + 1).alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "a", "b").limit(1)


class Merges:
    """Ordered merges; ``train`` needs distinct words with counts, which the cluster has aggregated."""

    def __init__(self, merges: list[tuple[str, str]], symbols: int = 0, history: list[dict] | None = None):
        self.merges, self.symbols, self.history = merges, symbols, history or []
        self.ranks = {m: i for i, m in enumerate(merges)}

    @property
    def vocab_size(self) -> int:
        return self.symbols + len(self.merges)

    @classmethod
    def train(cls, counts: dict[str, int], n: int, record: int = 30) -> "Merges":
        words = [[*w, END] for w in counts]
        weight = list(counts.values())
        total: dict[tuple[str, str], int] = defaultdict(int)
        holders: dict[tuple[str, str], set[int]] = defaultdict(set)
        for k, s in enumerate(words):
            for pair in zip(s, s[1:]):
                total[pair] += weight[k]
                holders[pair].add(k)
        symbols, merges, history = len({x for s in words for x in s}), [], []
        queue = [(-c, p) for p, c in total.items()]
        heapq.heapify(queue)
        while queue and len(merges) < n:
            c, pair = heapq.heappop(queue)
            if total.get(pair, 0) != -c:  # out of date: the right count is in the queue as well
                continue
            if -c < 2:
                break
            merges.append(pair)
            if len(history) < record:
                history.append({"step": len(merges), "pair": pair, "count": -c})
            changed: dict[tuple[str, str], int] = defaultdict(int)
            for k in holders.pop(pair):
                s, out = words[k], []
                for p in zip(s, s[1:]):
                    changed[p] -= weight[k]
                i = 0
                while i < len(s):
                    both = i + 1 < len(s) and (s[i], s[i + 1]) == pair
                    out.append(s[i] + s[i + 1] if both else s[i])
                    i += 2 if both else 1
                for p in zip(out, out[1:]):
                    changed[p] += weight[k]
                    holders[p].add(k)
                words[k] = out
            for p, d in changed.items():
                if d:
                    total[p] += d
                    if total[p] > 0 and p != pair:
                        heapq.heappush(queue, (-total[p], p))
            total.pop(pair, None)
        return cls(merges, symbols, history)

    def prefix(self, n: int) -> "Merges":
        """The first n merges: one training run serves every size."""
        return Merges(self.merges[:n], self.symbols)

    def encode_word(self, word: str) -> list[str]:
        s = [*word, END]
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.ranks.get((s[i], s[i + 1]), len(self.ranks)))
            if (s[best], s[best + 1]) not in self.ranks:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def encode(self, words: Column) -> Column:
        """Pieces of an array of words."""
        ranks, symbols = self.merges, self.symbols

        @F.pandas_udf("array<string>")
        def run(series: pd.Series) -> pd.Series:
            known = _word_encoder(tuple(ranks), symbols)
            return series.map(lambda ws: [p for w in ws for p in known(w)])

        return run(words)

    def piece_counts(self, words: Column) -> Column:
        """The number of pieces of an array of words; each distinct word of a batch is looked up once."""
        ranks, symbols = self.merges, self.symbols

        @F.arrow_udf("long")
        def run(lists: pa.Array) -> pa.Array:
            known = _word_encoder(tuple(ranks), symbols)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            each = lists.flatten().dictionary_encode()
            of = np.array([len(known(w)) for w in each.dictionary.to_pylist()], "i8")
            before = np.concatenate([[0], np.cumsum(of[each.indices.to_numpy()])])
            ends = np.cumsum(sizes)
            return pa.array(before[ends] - before[ends - sizes], pa.int64(), mask=lists.is_null().to_numpy(zero_copy_only=False))

        return run(words)


@lru_cache(maxsize=2)
def _word_encoder(merges: tuple, symbols: int):
    """Encodes words with a bounded memory of those seen before; a worker keeps it from batch to batch."""
    return lru_cache(maxsize=100_000)(Merges(list(merges), symbols).encode_word)


# ---- training over more distinct words than the driver holds
#: Symbols are numbers on the cluster: a character is its code point, longer ones come after them.
_LONGER, _GAP = 0x110000, -1


class _PairCounts:
    """Counts of pairs, and the commonest of them, ties by the pair."""

    def __init__(self, total: dict):
        self.total = total
        self.queue = [(-c, p) for p, c in total.items()]
        heapq.heapify(self.queue)

    def best(self):
        while self.queue and self.total.get(self.queue[0][1], 0) != -self.queue[0][0]:
            heapq.heappop(self.queue)
        return self.queue[0] if self.queue else None

    def merged(self, pair, changes) -> None:
        for p, d in changes:
            self.total[p] = self.total.get(p, 0) + d
            if self.total[p] > 0 and p != pair:
                heapq.heappush(self.queue, (-self.total[p], p))
            elif self.total[p] <= 0:
                del self.total[p]
        self.total.pop(pair, None)


class _Words:
    """Words as one array of symbols with a gap after each, and the count of its word beside each symbol."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        ends = np.cumsum(sizes)
        self.symbols = np.insert(symbols.astype("i4"), ends, _GAP)
        self.counts = np.repeat(counts.astype("i8"), sizes + 1)

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs that start at these places, and their counts."""
        at = at[(at >= 0) & (at < len(self.symbols) - 1)]
        at = at[(self.symbols[at] != _GAP) & (self.symbols[at + 1] != _GAP)]
        return self.symbols[at].astype("i8") << 32 | self.symbols[at + 1], self.counts[at]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*self.pairs(np.arange(len(self.symbols))))

    def merge(self, a: int, b: int, new: int, record: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Merges a pair from left to right in every word; gives the change of each pair's count."""
        s = self.symbols
        at = np.flatnonzero(s[:-1] == a)
        at = at[s[at + 1] == b]
        if a == b and len(at):  # of a run every other place
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
        if not len(at):
            return np.empty(0, "i8"), np.empty(0, "i8")
        old = self.pairs(np.unique(np.concatenate([at - 1, at, at + 1]))) if record else None
        s[at] = new
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        self.symbols, self.counts = s[keep], self.counts[keep]
        if not record:
            return np.empty(0, "i8"), np.empty(0, "i8")
        at = at - np.arange(len(at))
        now = self.pairs(np.unique(np.concatenate([at - 1, at])))
        return summed(np.concatenate([old[0], now[0]]), np.concatenate([-old[1], now[1]]))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number sums of the values of equal keys."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(values, first)


def _changes(state: DataFrame, done: list[tuple[int, int, int]], tried: list[tuple[int, int, int]], start: bool = False) -> DataFrame:
    """(step, pair, change): counts of all pairs (step -1, where ``start``) and their changes under merges tried in turn after those done."""

    def run(batches):
        found: dict[int, list] = defaultdict(list)
        waiting = 0
        for b in batches:
            words = _Words(b.column(0).flatten().to_numpy(), b.column(0).value_lengths().to_numpy(), b.column(1).to_numpy())
            for m in done:
                words.merge(*m, record=False)
            if start:
                found[-1].append(words.all_pairs())
            for step, m in enumerate(tried):
                found[step].append(words.merge(*m))
            waiting += 1
            if waiting == 32:
                found, waiting = defaultdict(list, {k: [summed(*map(np.concatenate, zip(*v)))] for k, v in found.items()}), 0
        for step, v in found.items():
            keys, values = summed(*map(np.concatenate, zip(*v)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), step, "i4")), pa.array(keys), pa.array(values)], ["step", "pair", "change"])

    parts = state.mapInArrow(run, "step int, pair long, change long")
    return parts.groupBy("step", "pair").agg(F.sum("change").alias("change")).filter("change <> 0")


def _advanced(state: DataFrame, done: list[tuple[int, int, int]]) -> DataFrame:
    """The words after merges."""

    def run(batches):
        for b in batches:
            words = _Words(b.column(0).flatten().to_numpy(), b.column(0).value_lengths().to_numpy(), b.column(1).to_numpy())
            for m in done:
                words.merge(*m, record=False)
            inner = words.symbols != _GAP
            ends = np.cumsum(inner)[~inner]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(words.symbols[inner])), b.column(1)], ["symbols", "count"])

    return state.mapInArrow(run, "symbols array<int>, count long")


def _frequent(state: DataFrame, bound: int) -> list:
    """The commonest words, as many whole classes of counts (by eighths of a power of two) as the bound allows."""
    level = F.floor(F.log2("count") * 8)
    at, n = None, 0
    for r in sorted(state.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += r.n
        if n > bound:
            break
        at = r.level
    return [] if at is None else state.filter(level >= at).collect()


def train(docs: DataFrame, n: int = 2000, frequent: int = 1 << 16, most: int = 256, store_every: int = 64) -> Merges:
    """Merges over all distinct words, which stay on the cluster; the driver holds the counts of pairs of symbols.

    The driver proposes the next merges from the exact counts of pairs and, for their changes, from
    the commonest words. The cluster applies the proposals to every word and returns how the count
    of each pair changes at each step. With these the driver goes through the steps: a
    proposal counts if it is the commonest pair by exact counts, and the first that is not ends the
    round. So the frequent words decide only how many merges a round yields (one at least), never which.
    """
    spark = docs.sparkSession
    counts = word_counts(docs)
    chars = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.ascii(c))
    path = scratch(spark, "bpe-words")
    counts.select(F.concat(chars, F.array(F.lit(_LONGER))).alias("symbols"), "count").write.parquet(path)
    read = lambda path: spark.read.parquet(path).coalesce(spark.sparkContext.defaultParallelism)  # noqa: E731, a task for each core: there are many rounds
    state = read(path)
    names, ids = {_LONGER: END}, {END: _LONGER}
    name = lambda i: names.get(i) or chr(i)

    def number(symbol: str) -> int:
        if len(symbol) == 1:
            return ord(symbol)
        i = ids.setdefault(symbol, _LONGER + len(ids))
        names[i] = symbol
        return i

    numbered = lambda pair: (number(pair[0]), number(pair[1]), number(pair[0] + pair[1]))
    named = lambda key: (name(key >> 32), name(key & 0xFFFFFFFF))
    exact = _PairCounts({named(r.pair): r.change for r in _changes(state, [], [], True).collect()})  # pairs of characters
    start = len(set(chain.from_iterable(exact.total)))
    some = _frequent(state, frequent)
    own = _Words(np.array([x for r in some for x in r[0]], "i4"), np.array([len(r[0]) for r in some], "i8"), np.array([r[1] for r in some], "i8"))
    merges, history, done, size = [], [], [], 64
    while len(merges) < n:
        guess, words = _PairCounts(dict(exact.total)), _Words(np.empty(0, "i4"), np.empty(0, "i8"), np.empty(0, "i8"))
        words.symbols, words.counts = own.symbols.copy(), own.counts
        tried: list[tuple[str, str]] = []
        while len(tried) < min(size, most, n - len(merges)) and (best := guess.best()) and -best[0] >= 2:
            c, pair = -best[0], best[1]
            tried.append(pair)
            keys, values = words.merge(*numbered(pair))
            a, b, _ = numbered(pair)
            seen = -values[keys == (a << 32 | b)].sum()
            if not seen:
                break
            guess.merged(pair, [(named(int(k)), int(v) * c / seen) for k, v in zip(keys, values)])
        if not tried:
            break
        changes: dict[int, list] = defaultdict(list)
        for r in _changes(state, done, [numbered(p) for p in tried]).toLocalIterator():
            changes[r.step].append((named(r.pair), r.change))
        taken = 0
        for step, pair in enumerate(tried):
            best = exact.best()
            if best is None or best[1] != pair or -best[0] < 2:
                break
            merges.append(pair)
            if len(history) < 30:
                history.append({"step": len(merges), "pair": pair, "count": -best[0]})
            exact.merged(pair, changes[step])
            done.append(numbered(pair))
            own.merge(*numbered(pair), record=False)
            taken += 1
        size = max(8, 2 * taken)
        if len(done) >= store_every and len(merges) < n:
            old, path = path, scratch(spark, "bpe-words")
            _advanced(state, done).write.parquet(path)
            state, done = read(path), []
            discard(spark, old)
    discard(spark, path)
    return Merges(merges, start, history)


def train_bytes(docs: DataFrame, vocab_size: int = 8000, max_bytes: int = 64 << 20):
    """A byte-level tokenizer of the ``tokenizers`` library, trained on documents of about ``max_bytes`` chosen by a hash (all, if that is more)."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    total, span = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, 1 << 40
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)) < min(span, span * max_bytes // max(1, total)))
    out = Tokenizer(models.BPE(unk_token="[UNK]"))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    texts = (r.text for r in some.filter("text is not null").select("doc_id", "text").orderBy("doc_id", "text").toLocalIterator())
    out.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=vocab_size, special_tokens=["[UNK]"], show_progress=False))
    return out


def curve(docs: DataFrame, merges: Merges, sizes: tuple[int, ...] = (100, 250, 500, 1000, 1500, 2000, 3000, 4000)) -> DataFrame:
    """(merges, vocabulary_size, corpus_tokens): prefixes of one training run over the distinct words, weighted by their counts."""
    counts, out = word_counts(docs), None
    for n in (n for n in sizes if n <= len(merges.merges)):
        part = merges.prefix(n)
        pieces = counts.select(F.col("count"), part.encode(F.array("word")).alias("p"))
        one = pieces.agg(F.sum(F.size("p") * F.col("count")).alias("corpus_tokens")).select(F.lit(n).alias("merges"), F.lit(part.vocab_size).alias("vocabulary_size"), "corpus_tokens")
        out = one if out is None else out.union(one)
    return out


def word_pieces(words: list[str], merges: dict[str, Merges]) -> list[dict]:
    """Each of a few words with its pieces under several trained merges, words with marks by their parts."""
    parts = lambda w: [w.lower()] if re.fullmatch("[A-Za-z]+", w) else re.findall("[a-z]+|[0-9]+", w.lower())
    return [{"word": w} | {name: [p for x in parts(w) for p in m.encode_word(x)] for name, m in merges.items()} for w in words]


# ---- word-level vocabulary
_SPLIT = r'([,.:;?_!"()\']|--|\s)'


def word_level(text: Column) -> Column:
    """Words and marks by a splitting pattern that keeps its separators, without blanks."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'--|[,.:;?_!"()\']|(?:(?!--)[^,.:;?_!"()\'\s])+'), F.lit(0)), lambda t: F.trim(t)), lambda t: t != "")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, id): sorted tokens, then the two specials. Ids by range partitions: no single task sorts the vocabulary."""
    from pyspark.sql import Window

    toks = docs.select(F.explode(word_level(F.col("text"))).alias("token")).distinct()
    first = toks.withColumn("h", F.substring("token", 1, 2))
    before = first.groupBy("h").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("h")) - F.col("n"))
    ids = first.join(before.select("h", "before"), "h").select("token", (F.col("before") + F.row_number().over(Window.partitionBy("h").orderBy("token")) - 1).alias("id"))
    n = toks.agg(F.count("*").alias("n"))
    return ids.union(n.select(F.explode(F.array(F.struct(F.lit(END_OF_TEXT).alias("token"), F.col("n").alias("id")), F.struct(F.lit(UNKNOWN).alias("token"), (F.col("n") + 1).alias("id")))).alias("x")).select("x.*"))


def encode_words(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, i, token, id): unknown tokens have the id of the unknown."""
    toks = docs.select("doc_id", F.posexplode(word_level(F.col("text"))).alias("i", "token"))
    unknown = vocab.filter(F.col("token") == UNKNOWN).select(F.col("id").alias("unknown"))
    return toks.join(vocab, "token", "left").join(F.broadcast(unknown)).select("doc_id", "i", "token", F.coalesce("id", "unknown").alias("id"))


def decode(words: Column) -> Column:
    """Tokens back to text; marks lose the space before them."""
    return F.regexp_replace(F.array_join(words, " "), r"\s+([,.?!\"()'])", "$1")


def oov_rate(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    toks = docs.select(F.explode(word_level(F.col("text"))).alias("token"))
    return toks.join(vocab.withColumnRenamed("id", "known"), "token", "left").agg(F.count("*").alias("tokens"), F.count_if(F.col("known").isNull()).alias("unknown")).withColumn("oov_rate", F.round(F.col("unknown") / F.greatest(F.lit(1), F.col("tokens")), 4))


# ---- pretrained ranks, where a file is supplied
def rank_pieces(text: Column, ranks_path: str, pattern: str) -> Column:
    """Pieces under a rank file (base64 token and rank on each line)."""

    @F.pandas_udf("array<string>")
    def run(series: pd.Series) -> pd.Series:
        enc = _encoding(ranks_path, pattern)
        return series.map(lambda t: [enc.decode_single_token_bytes(i).decode("utf-8", "replace") for i in enc.encode_ordinary(t or "")])

    return run(text)


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("supplied", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
