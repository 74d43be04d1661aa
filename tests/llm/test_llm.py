"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import ann, decontaminate, graph, langid, licenses, mixing, repeats, simhash, token_counts, token_shards, toxicity, unit_bpe
from loomtext.llm.common import bounded_sample

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, digest string, position string, fp string, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, words(rng, rng.randint(1, 60)), "en", f"s{i % 3}") for i in range(40)]
    out += [(100, None, None, None), (101, "", "en", "s0"), (102, "  \n\t ", "en", "s1"), (103, "Ünïcödé — “x” İΣ <|endoftext|> é", "fr", "s1"), (104, words(rng, 3000), "en", "s0")]
    out += [(200, out[0][1], "en", "s0"), (0, out[0][1], "en", "s0"), (None, "no id", "en", "s2"), (None, "no id", "en", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).limit(0)


# ---- tokenizers
def test_unit_encoding_equals_library():
    rng = random.Random(2)
    libs = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    parts = ["<|endoftext|>", "'s", " ", "\n", "DON'T", "a", "B", "9", "½", "²", "é", "é", "İ", "Σ", "σ", " ", "­", "\t", "中", "_", "-.", "\x1c", "\x85", "ª", "  "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert unit_bpe.counter(WORD).count(t) == len(libs[0].encode(t, add_special_tokens=False).ids)
        assert unit_bpe.encoder(BYTE).encode(t) == np.array(libs[1].encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(unit_bpe, "_CAP", 10)
    c = unit_bpe.UnitCounter(WORD)
    t = " ".join(f"w{i}" for i in range(100))
    assert c.count(t) == len(Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids) and len(c.unit) <= 11


def test_token_counts(spark, docs, rows, none, tmp_path):
    lib = Tokenizer.from_file(WORD)
    want = sorted(((r[0] if r[0] is not None else -1), len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    store = f"file://{tmp_path}/store"
    for again in (False, True):
        got = token_counts.token_counts(docs, WORD, store).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    runs = [spark.read.schema("digest binary").parquet(str(p)).distinct().count() for p in (tmp_path / "store").iterdir()]
    assert sorted(runs)[0] == 0 and sum(runs) == len({re.sub(r"[ \t\n\r]+", " ", (r[1] or "")).lower() if "<|" not in (r[1] or "") else r[1] for r in rows})  # the second run encoded nothing
    assert token_counts.token_counts(none, WORD).count() == 0


def test_shards_round_trip(spark, docs, rows, none):
    lib = Tokenizer.from_file(BYTE)
    m = token_shards.write_shards(docs.select(F.col("doc_id").alias("number"), "doc_id", "text"), BYTE)
    got = token_shards.read_shards(m).orderBy("start").collect()
    start = 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows) == m.agg(F.sum("n_docs")).first()[0]
    shards = [(bytes(s.first_key), bytes(s.last_key), s.path) for s in m.collect()]
    for doc_id, text, *_ in rows:
        k = token_shards.key_of(doc_id)
        found = [x for a, b, p in shards if a <= k <= b for x in token_shards.ShardReader(p).get(k)]
        assert any(d == doc_id and list(i) == [*lib.encode(text or "", add_special_tokens=False).ids, 0] for d, i in found)
    assert all(not token_shards.ShardReader(p).get(token_shards.key_of(10**9)) for *_, p in shards)
    assert token_shards.read_shards(token_shards.write_shards(none.select(F.col("doc_id").alias("number"), "doc_id", "text"), BYTE)).count() == 0


def test_shard_blocks_and_damage(tmp_path):
    p = tmp_path / "x.sst"
    w = token_shards.ShardWriter(open(p, "wb"), block_bytes=64)
    for i in range(-50, 50):
        w.add(token_shards.key_of(i), b"\1" + i.to_bytes(8, "little", signed=True) + b"\0" * 4, 1)
    w.close()
    r = token_shards.ShardReader(f"file://{p}")
    assert len(r.blocks) > 10 and [token_shards.unpack(v)[0] for _, v in r] == list(range(-50, 50)) and r.get(token_shards.key_of(-7))[0][0] == -7
    raw = bytearray(p.read_bytes())
    raw[-60] ^= 1
    p.write_bytes(raw)
    with pytest.raises(ValueError):
        token_shards.ShardReader(f"file://{p}")


# ---- decontamination
def test_decontamination(spark, none):
    rng = random.Random(3)
    items = [(i, words(rng, n, "klmnopq")) for i, n in enumerate((40, 20, 14, 9, 5))] + [(9, None), (10, ""), (11, words(rng, 60, "klmnopq"))]
    clean = [(i, words(rng, 200), "en", "s") for i in range(20)]

    def altered(t, every):
        w = t.split()
        return " ".join("zz" if i % every == every - 1 else x for i, x in enumerate(w))

    bad = [(100 + i, f"{words(rng, 50)} {t.upper()}, {words(rng, 30)}", "en", "s") for i, t in items if t]
    bad += [(200, words(rng, 9) + " " + altered(items[0][1], 9), "en", "s"), (201, " ".join(items[7][1].split()[20:45]), "en", "s")]
    d = docs_of(spark, clean + bad + [(300, None, None, None), (301, "", None, None)])
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 100):  # sent and joined
        got = {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated_documents(d, b, block_bytes=size).collect()}
        assert got == {100 + i: [i] for i, t in items if t and i != 4} | {200: [0], 201: [11]}
        left = sorted(r.doc_id for r in decontaminate.decontaminated(d, b, block_bytes=size).collect())
        assert left == sorted([r[0] for r in clean] + [104, 300, 301])  # an item of five words is no evidence
    assert sorted(r.item_id for r in decontaminate.short_items(b).collect()) == [4, 9, 10]
    assert decontaminate.contaminated_documents(none, b).count() == 0
    assert decontaminate.contaminated_documents(d, b.limit(0)).count() == 0


def test_decontamination_of_scattered_substitutions():
    """Whole copies at an identity of 0.8 are found wherever the substitutions are; below it they are not."""
    rng = random.Random(4)
    for n in range(12, 33):
        item = [f"w{i}" for i in range(n)]
        index = decontaminate.SeedIndex([(1, " ".join(item))])
        for _ in range(40):
            lost = set(rng.sample(range(n), n // 5))
            text = ["a", "b", *("zz" if i in lost else w for i, w in enumerate(item)), "c"]
            kept = [i for i in range(n) if i not in lost]
            assert [x[3] for x in index.find(" ".join(text))] == [len(kept)]
        assert not index.find(" ".join("zz" if i % 3 == 2 else w for i, w in enumerate(item)))
    assert decontaminate.SeedIndex([(1, " ".join(f"w{i}" for i in range(16)))]).find(" ".join("zz" if i in (6, 10, 13) else f"w{i}" for i in range(16))) == [(1, 0, 16, 13, 13 / 16)]


def brute_overlaps(text, item, min_words=13):
    """The most matches in any aligned window of identity 0.8 or more, if enough of the item."""
    t, i, best = text.lower().split(), item.lower().split(), 0
    if len(i) < 8:
        return 0
    for shift in range(-len(i) + 1, len(t)):
        same = [t[k] == i[k - shift] for k in range(max(0, shift), min(len(t), shift + len(i)))]
        for x in range(len(same)):
            for y in range(x + 1, len(same) + 1):
                n = sum(same[x:y])
                if n >= 0.8 * (y - x):
                    best = max(best, n)
    return best if best >= min(min_words, -(-8 * len(i) // 10)) else 0


def test_decontamination_equals_brute_force(spark):
    """Both ways of joining against all windows of all diagonals, with few words (hot seeds), repeats, ties and a long text."""
    rng = random.Random(14)
    draw = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(k, draw(rng.randint(8, 24), rng.choice((2, 6, 40)))) for k in range(12)] + [(3, draw(15, 40)), (50, None)]
    rows = []
    for k in range(40):
        w = rng.choice([x for _, x in items if x]).split()
        for _ in range(rng.randint(0, len(w) // 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((k % 35, f"{draw(rng.randint(0, 12), 6)} {' '.join(w)} {draw(rng.randint(0, 12), 40)}", "en", "s"))
    rows += [(90, draw(2500, 2), "en", "s"), (91, None, None, None), (None, items[0][1], "en", "s")]
    d, b = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    long = rows[40]
    want = set()
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            if text and item and (doc_id, text) != long[:2] and (n := brute_overlaps(text, item)):
                want.add((doc_id, item_id, n))
    best = {}
    for doc_id, item_id, n in want:
        best.setdefault((doc_id, item_id), set()).add(n)
    for size in (8 << 20, 10):
        got = {}
        for r in decontaminate.contaminated(d, b, block_bytes=size).collect():
            if r.doc_id != 90:
                got.setdefault((r.doc_id, r.item_id), set()).add(r.matched)
        assert got.keys() == best.keys() and all(max(got[k]) == max(best[k]) for k in best)
        assert {r.doc_id for r in decontaminate.contaminated_documents(d, b, block_bytes=size).collect()} >= {k for k, _ in best}


# ---- mixing
def edf(weights):
    q, had, out = sum(weights), [0] * len(weights), []
    for t in range(q):
        ready = [((-(-(had[i] + 1) * q // n)), i) for i, n in enumerate(weights) if had[i] * q // n <= t]
        i = min(ready)[1]
        out.append(i)
        had[i] += 1
    return out


def test_period_is_fair(spark):
    w = spark.createDataFrame([("=a", 5), ("=b", 3), ("=c", 1), ("", 7)], "src string, n long")
    got = mixing.period(w).orderBy("slot").collect()
    order = sorted(["", "=a", "=b", "=c"])
    weights = dict([("=a", 5), ("=b", 3), ("=c", 1), ("", 7)])
    assert [order.index(r.src) for r in got] == edf([weights[s] for s in order])
    had = collections.Counter()
    for r in got:
        had[r.src] += 1
        assert all(abs(had[s] - (r.slot + 1) * n / 16) < 1 for s, n in weights.items())


def test_period_of_many_sources_and_fine_weights(spark):
    rng = random.Random(16)
    for weights in ([rng.randint(1, 9) for _ in range(300)], [60_001, 39_998, 1]):
        w = spark.createDataFrame([(f"={i:04d}", n) for i, n in enumerate(weights)], "src string, n long")
        got = [int(r.src[1:]) for r in mixing.period(w).orderBy("slot").collect()]
        assert got == edf(weights)


def test_schedule_of_a_shared_id(spark):
    """A third of the rows have one doc_id, another third none; many are equal as a whole."""
    d = docs_of(spark, [(i, "x", "en", "s0") for i in range(100)] + [(7, f"t{i % 9}", "en", "s0") for i in range(100)] + [(None, "y", "en", "s1") for _ in range(100)])
    got = mixing.schedule(d, bucket_rows=4, block_rows=4).collect()
    assert sorted(r.position for r in got) == list(range(300)) and all(r.release <= r.slot < r.deadline for r in got)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in d.collect())
    assert mixing.mixed(d, block_rows=4).count() == 300


def test_schedule(spark, docs, rows, none):
    for buckets in (4096, 5):
        got = mixing.schedule(docs, {"s0": 3, "s1": 2, "s2": 1}, block_rows=4, bucket_rows=buckets).orderBy("position").collect()
        assert len(got) == len(rows) and [r.position for r in got] == list(range(len(rows)))
        assert all(r.release <= r.slot < r.deadline for r in got) and [r.slot for r in got] == sorted(r.slot for r in got)
        assert collections.Counter(r.source for r in got) == collections.Counter(r[3] for r in rows)
    assert mixing.schedule(none).count() == 0


def test_mixed_keeps_all_rows(spark, docs, rows):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))


# ---- neighbours
@pytest.mark.parametrize("sizes", [{}, dict(cell_rows=60, chunk_rows=40, query_rows=3)])
def test_nearest(spark, sizes):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[:120] = x[0]  # a vector that many rows share
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0, None] + [0.0] * 10), (None, [1.0] * 12), (380, [float(v) for v in x[380]])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(v, k=10, **sizes).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    d = x.astype(float)
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = (d * d[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:10]
        hits += len(set(order) & {i for _, i, _ in found})
        assert [r for r, *_ in found] == list(range(1, 11)) and all(v == s[i] for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
    assert hits >= 0.9 * 10 * len(got)


def test_box_tree():
    rng = np.random.default_rng(7)
    for n in (1, 5, 16, 17, 300):
        low = rng.normal(size=(n, ann.DIM))
        high = low + rng.random((n, ann.DIM))
        tree = ann.BoxTree(low, high, fan=4)
        for q in rng.normal(size=(30, ann.DIM)):
            far = ann._box_distance(q, low, high)
            limit = float(np.quantile(far, rng.random()))
            assert sorted(tree.within(q, limit).tolist()) == np.flatnonzero(far <= limit).tolist()
            assert far[tree.nearest(q)] == far.min()


def test_nearest_of_few_and_none(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(v).orderBy("query_id", "rank").collect()] == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.nearest(v.limit(0)).count() == 0


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95) - 12.5916) < 1e-3


# ---- toxicity and language
def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(10, rng)
    P = rng.normal(size=(5, 3, 6 * toxicity.HIDDEN)).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pad = np.zeros((5, 3), bool)
    pad[3:, 1] = True
    w = rng.normal(size=3)
    _, state = net.forward(P, pad, keep=True)
    grad, dP = net.backward(w, state)
    f = lambda: float(net.forward(P, pad)[0] @ w)
    for k in ("U0", "U1", "A", "v", "w", "c0", "c1", "a"):
        x = net.p[k]
        at = tuple(rng.integers(n) for n in x.shape)
        old = x[at]
        x[at] = old + 1e-3
        up = f()
        x[at] = old - 1e-3
        down = f()
        x[at] = old
        assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-3 * max(1, abs(grad[k][at]))
    old = P[2, 0, 9]
    P[2, 0, 9] = old + 1e-3
    up = f()
    P[2, 0, 9] = old - 1e-3
    assert abs((up - f()) / 2e-3 - dP[2, 0, 9]) < 2e-3


def test_windows_cover_all_words():
    for n in range(0, 200):
        seen = set()
        for s in toxicity.windows(n):
            seen |= set(range(s, min(n, s + toxicity.WINDOW)))
        assert seen == set(range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        t, bad = words(rng, rng.randint(5, 120)).split(), i % 3 == 0
        if bad:
            for _ in range(3):
                t.insert(rng.randint(0, len(t)), rng.choice(["zqzq", "wywy", "kxkx"]))
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, 1, int(bad)))
    labels += [(9999, 1, 1), (3, 1, None)]
    return docs_of(spark, rows).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, labelled, docs, none):
    d, labels = labelled
    model = toxicity.fit(d, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = toxicity.score_documents(d, model).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert toxicity.score_documents(docs, model).filter("score is null or held_out is null").count() == 0
    assert toxicity.score_documents(docs, model).count() == docs.count()
    assert toxicity.without_toxic(d, model).count() == sum(1 - r.predicted for r in got)
    assert toxicity.score_documents(none, model).count() == 0
    # windows, batches and long texts don't change a score
    texts = [t.encode() for t in (words(random.Random(8), 70_000), "a zqzq b", "")]
    one = [model.logits([toxicity.words_of(t)])[0] for t in texts]
    assert np.allclose(one, model.logits([toxicity.words_of(t) for t in texts]), atol=1e-4)
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).count() == docs.count()  # nothing to learn from


def slow_score(model, text):
    """The network word by word and gate by gate, in plain Python numbers."""
    import math

    p = {k: v.astype(float) for k, v in model.net.p.items()}
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower().encode()) if w]

    def vector(w):
        b = b"<" + w + b">"
        grams = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % (1 << 32)) >> (32 - toxicity.CHAR_BITS) for i in range(len(b) - 2)]
        return np.concatenate([p["E"][model.vocab.get(w, 0)], np.mean([p["C"][g] for g in grams], axis=0)])

    def gru(xs, U, c):
        state, out = np.zeros(h), []
        for x in xs:
            g = state @ U
            z, r = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
            n = np.tanh(x[2 * h :] + r * (g[2 * h :] + c))
            state = (1 - z) * n + z * state
            out.append(state)
        return out

    best = -math.inf
    for start in range(0, max(1, len(words)), toxicity.STRIDE):
        part = words[start : start + toxicity.WINDOW]
        xs = [vector(w) @ p["X"] + p["x"] for w in part]
        both = [np.concatenate(x) for x in zip(gru([x[: 3 * h] for x in xs], p["U0"], p["c0"]), gru([x[3 * h :] for x in xs][::-1], p["U1"], p["c1"])[::-1])]
        e = np.exp([np.tanh(x @ p["A"] + p["a"]) @ p["v"] for x in both])
        best = max(best, float(sum(w * x for w, x in zip(e / e.sum(), both)) @ p["w"] + p["b"][0]) if part else float(p["b"][0]))
        if start + toxicity.WINDOW >= len(words):
            break
    return 1 / (1 + math.exp(-(model.scale * best + model.shift)))


def test_toxicity_learns_from_long_texts_where_a_label_has_no_others(spark, labelled, monkeypatch):
    """Only long texts are toxic here: windows of them are learnt from; long texts of the other label are left out."""
    d, labels = labelled
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, prior: seen.append(sorted(zip(y, map(len, texts)))))
    ids = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").collect()}
    long_ids = [i for i, t in ids.items() if t == 1] + [i for i, t in ids.items() if t == 0][:5]
    toxicity.fit(d.withColumn("text", F.when(F.col("doc_id").isin(long_ids), F.repeat("text", 2000)).otherwise(F.col("text"))), labels, max_bytes=5000)
    assert {y for y, _ in seen[0]} == {0, 1} and {n for y, n in seen[0] if y == 1} == {5000}
    toxicity.fit(d, labels, max_bytes=5000)
    assert [x for x in seen[1] if x[0] == 0] != [] and len([x for x in seen[0] if x[0] == 0]) < len([x for x in seen[1] if x[0] == 0])


def test_toxicity_equals_plain_arithmetic(spark, labelled):
    d, labels = labelled
    model = toxicity.fit(d, labels)
    rng = random.Random(21)
    rows = [(i, words(rng, n) + (" zqzq" if i % 2 else ""), None, None) for i, n in enumerate((0, 1, 5, 31, 32, 33, 48, 49, 200, 700))] + [(50, "ÜBER größer, naïve! 3/4", None, None), (51, None, None, None), (52, "—", None, None)]
    got = {r.doc_id: r for r in toxicity.score_documents(docs_of(spark, rows), model).collect()}
    for doc_id, text, *_ in rows:
        want = slow_score(model, text)
        assert abs(got[doc_id].score - want) < 1e-4, (text, got[doc_id].score, want)
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.5)


def test_langid_equals_plain_arithmetic(spark):
    rng = random.Random(22)
    kinds = {"aa": "abcde", "bb": "fghij"}
    model = langid.train([(words(rng, 40, v), k) for k, v in kinds.items() for _ in range(60)])
    rows = [(i, t, None, None) for i, t in enumerate(["a", "Éa b-c", "abc def 12 ghi", words(rng, 300, "abcfgh"), "x" * 5, "1é2"])]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, rows), model).collect()}
    for doc_id, text, *_ in rows:
        b = b" " + bytes(x if x > 127 or chr(x).isalpha() else 32 for x in text.lower().encode()) + b" "
        grams = [(n, int.from_bytes(b[i : i + n], "big")) for n in (2, 3, 4) for i in range(len(b) - n + 1)]
        at = [((code * 2654435761 + n * 40503) % (1 << 32)) >> (32 - model.bits) for n, code in grams]
        z = (sum(model.table[x].astype(float) for x in at) / len(at) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[doc_id].lang_pred == model.languages[int(p.argmax())] and abs(got[doc_id].score - p.max()) < 1e-6


def test_long_texts(spark):
    """Texts of megabytes through the operators that read them in parts."""
    rng = random.Random(23)
    long = words(rng, 400_000)
    d = docs_of(spark, [(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, "x" * 300_000, "en", "s"), (4, "short", "en", "s")])
    lib = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    text = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    for r in token_counts.token_counts(d, WORD).collect():
        assert r.n_tokens == len(lib[0].encode(text[r.doc_id], add_special_tokens=False).ids)
    for r in token_shards.read_shards(token_shards.write_shards(d.select(F.col("doc_id").alias("number"), "doc_id", "text"), BYTE)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*lib[1].encode(text[r.doc_id], add_special_tokens=False).ids, 0], "<u4").tobytes())
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    assert got[4].fingerprint == f"{reference_fingerprint('short'):016x}" and got[2].component_id == got[1].component_id == 1
    item = " ".join(long.split()[200_000:200_020])
    found = decontaminate.contaminated(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2} and all(r.matched == 20 and r.at == 200_000 for r in found)


def test_langid(spark, docs, none):
    rng = random.Random(6)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, words(rng, rng.randint(3, 80), kinds[k]), k, "s") for i, k in enumerate(rng.choices(list(kinds), k=400))]
    d = docs_of(spark, rows + [(900, None, "aa", "s"), (901, "12 !?", "aa", "s"), (902, "fgh fij", None, "s")])
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held) and all(got[r[0]].held_out for r in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, model).count() == docs.count() and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(d, langid.fit(none)).collect()} == {"und"}
    long = words(rng, 400_000, kinds["cc"])
    assert model.languages[int(model.probabilities(long.encode()).argmax())] == "cc"


def test_bounded_sample(spark):
    d = spark.range(10_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("k"))
    n = bounded_sample(d, "k", 500).groupBy("k").count().collect()
    assert len(n) == 3 and all(350 < r["count"] < 650 for r in n)


# ---- near-duplicates
def reference_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_miss_nothing():
    rng = random.Random(7)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("group", [4096, 1])
def test_near_duplicates(spark, docs, rows, none, monkeypatch, group):
    rng = random.Random(8)
    base = words(rng, 400).split()
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "q" * rng.randint(1, 5)
        near.append((1000 + i, " ".join(w), "en", "s0"))
    monkeypatch.setattr(simhash, "GROUP", group)
    every = [r for r in rows if r[0] is not None] + near
    d = docs_of(spark, every + [(None, "x", "en", "s")])
    got = simhash.near_duplicates(d).collect()
    assert len(got) == len(every) + 1
    fp = [reference_fingerprint(r[1]) for r in every]
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i, r in enumerate(every):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted((r[0], f"{fp[i]:016x}", least[find(i)]) for i, r in enumerate(every))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = [r.doc_id for r in simhash.keep_first(d).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(least.values())) and kept.count(None) == 1
    assert simhash.near_duplicates(none).count() == 0


def test_keep_first_of_clashing_ids(spark):
    """Unrelated rows that share a doc_id all stay; near-duplicates leave one, whatever their ids."""
    rng = random.Random(18)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, c, "en", "s"), (3, a, "en", "s"), (3, a, "en", "t"), (2, c, "en", "s"), (None, a, "en", "s"), (None, a, "en", "s"), (4, None, "en", "s"), (5, " ", "en", "s")]
    d = docs_of(spark, rows)
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_first(d).collect())
    assert kept == sorted([(1, a), (1, b), (2, c), (0, a), (0, a), (4, "")])
    assert simhash.keep_first(d).columns == d.columns
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(d).collect()}
    assert got[1, f"{reference_fingerprint(a):016x}"] == 1 and got[1, f"{reference_fingerprint(b):016x}"] == 1 and got[2, f"{reference_fingerprint(c):016x}"] == 2 and got[3, f"{reference_fingerprint(a):016x}"] == 1


def test_components_of_a_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in graph.components(e).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {500: 500, 501: 500}


# ---- repeats
def brute_repeats(texts, n):
    count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        hit = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i + 1 : i + 1 + n] = True
        kept = bytes(b for b, h in zip(t, hit[1:]) if not h)
        yield len(t), len(t) - len(kept), int((hit[1:] & ~hit[:-1]).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("suffixes, contexts", [(150_000, 20_000), (20, 20_000), (150_000, 1)])
def test_without_repeats(spark, docs, rows, none, monkeypatch, suffixes, contexts):
    monkeypatch.setattr(repeats, "SUFFIXES", suffixes)
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    rng = random.Random(9)
    shared = words(rng, 700)
    own = [(2000 + i, words(rng, 40) + shared[rng.randint(0, 900) : rng.randint(1200, 2500)] + words(rng, 60), "en", "s") for i in range(12)]
    own += [(2100, "ab" * 900, "en", "s"), (2101, "x" * 1000, "en", "s"), (2102, shared[:399], "en", "s"), (2103, shared[:400], "en", "s"), (None, shared[5:900] + "é", "en", "s")]
    every = rows + own
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs_of(spark, every)).collect())
    want = sorted((r[0] if r[0] is not None else -1, *x) for r, x in zip(every, brute_repeats([(r[1] or "").encode() for r in every], 400)))
    assert got == want and sum(x[2] for x in want) > 5000
    assert repeats.without_repeats(none).count() == 0


def brute_passages(rows, n):
    """Words of each row in strings of n words that a row of another id or text has too."""
    keys = [(r[0], r[1] or "") for r in rows]
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in keys]
    owners = collections.defaultdict(set)
    for k, t in zip(keys, texts):
        for i in range(len(t) - n + 1):
            owners[tuple(t[i : i + n])].add(k)
    for t in texts:
        yield len({j for i in range(len(t) - n + 1) if len(owners[tuple(t[i : i + n])]) > 1 for j in range(i, i + n)})


@pytest.mark.parametrize("suffixes, contexts", [(150_000, 20_000), (20, 20_000), (150_000, 1)])
def test_repeated_passages(spark, docs, rows, none, monkeypatch, suffixes, contexts):
    """Passages of 51 words of any length in bytes, white space apart, in other documents only."""
    monkeypatch.setattr(repeats, "SUFFIXES", suffixes)
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    rng = random.Random(15)
    shared, short = words(rng, 90).split(), [rng.choice("abcde") for _ in range(70)]
    own = []
    for i in range(14):
        at = rng.randint(0, 30)
        part = shared[at : at + rng.randint(48, 60)] if i % 2 else short[: 45 + i]
        own.append((3000 + i, f"{words(rng, rng.randint(0, 30))} {rng.choice((' ', chr(10), '  '))}{rng.choice((' ', '  ')).join(part)} {words(rng, rng.randint(0, 30))}", "en", "s"))
    line = words(rng, 30)
    own += [(3100, "\n".join([line] * 5), "en", "s"), (3101, words(rng, 300), "en", "s"), (3101, words(rng, 300), "en", "s"), (3102, "é " * 60, "en", "s"), (None, "é " * 55, "en", "s")]
    every = rows + own
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_repeated_words, r.kept) for r in repeats.without_repeats(docs_of(spark, every)).collect())
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), n) for r, n in zip(every, brute_passages(every, 51)))
    assert [x[:3] for x in got] == want and sum(n for *_, n in want) > 400
    assert all(len(x[3]) <= x[1] for x in got)


def test_word_codes(monkeypatch):
    rng = random.Random(17)
    text = words(rng, 3000).encode() + b"\t\n x\x0by "
    codes = repeats.word_codes(text)
    split = text.split()
    assert len(codes) == len(split) and len(set(codes.tolist())) == len(set(split)) and all((codes[i] == codes[j]) == (split[i] == split[j]) for i in range(0, 3000, 97) for j in range(0, 3000, 31))
    monkeypatch.setattr(repeats, "_WORDS", 50)
    repeats._powers.cache_clear()
    assert repeats.word_codes(text).tolist() == codes.tolist()
    repeats._powers.cache_clear()
    assert len(repeats.word_codes(b"")) == len(repeats.word_codes(b" \n")) == 0


def test_repeats_across_segments(monkeypatch):
    """The seam of the parts that a very long text is read in."""
    rng = random.Random(19)
    text = bytes(rng.choice(b"abcdef ") for _ in range(9000))
    one = [tuple(map(int, x)) for part in repeats.contexts(text, 400) for x in zip(*part)]
    monkeypatch.setattr(repeats, "_SEGMENT", 1000)
    many = [tuple(map(int, x)) for part in repeats.contexts(text, 400) for x in zip(*part)]
    cover = lambda cs: {(w, p, a) for p, s, e, a in cs for w in range(s, e + 1)}
    assert cover(one) == cover(many)


def test_maximal_repeats():
    rng = random.Random(10)
    for _ in range(150):
        texts, n = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 25))) for _ in range(3)], 4
        starts = [range(max(0, len(t) - n + 1)) for t in texts]
        got = {texts[m[0][0]][m[0][1] : m[0][1] + k]: sorted(m) for k, m in repeats.maximal_repeats(texts, starts, n)}
        places = collections.defaultdict(list)
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + n, len(t) + 1):
                    places[t[i:j]].append((k, i))
        want = {}
        for s, at in places.items():
            left = {texts[k][i - 1] if i else ("edge", k) for k, i in at}
            right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else ("edge", k) for k, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[s] = sorted(at)
        assert got == want
        flat = [x for _, m in repeats.maximal_repeats(texts, starts, n, every=False) for x in m]
        assert len(flat) == len(set(flat))


# ---- licences
def test_licences(spark, none):
    rng = random.Random(11)
    rows = [(i, "\n".join(words(rng, 12) for _ in range(4)), "en", "s") for i in range(60)]
    found = {500 + i: (f, t) for i, (f, t) in enumerate((f, ts[0]) for f, ts in licenses.TEMPLATES.items())}
    rows += [(k, f"{words(rng, 9)}\n{t}\n{words(rng, 5)}", "en", "s") for k, (_, t) in found.items()]
    rows += [(700, None, None, None), (701, "", None, None), (702, "She renewed her driving license last week.", "en", "s"), (703, "All rights reserved.", "en", "s"), (703, "All rights reserved.", "en", "s")]
    d = docs_of(spark, rows)
    model = licenses.fit(d)
    got = licenses.scan(d, model).collect()
    assert {r.doc_id: r.family for r in got if r.doc_id < 700} == {k: f for k, (f, _) in found.items()}
    assert all(r.confirmed and r.paragraph == 1 for r in got if r.doc_id < 700)
    assert [r.doc_id for r in got if r.doc_id >= 700] == [703, 703]
    for r in got:
        line = dict((x[0], x[1]) for x in rows)[r.doc_id].split("\n")[r.paragraph]
        assert abs(model.probabilities(line).max() - r.probability) < 1e-6
    # every paragraph that is left out, whether it was read or not, is unknown to the whole model
    rows += [(710, "long " * 30_000 + "rights", "en", "s"), (711, "Licensed under the\nLicensed under the MIT License\nreserved", "en", "s")]
    found = {(r.doc_id, r.paragraph, r.family): r.probability for r in licenses.scan(docs_of(spark, rows), model).collect()}
    unknown = len(model.families) - 1
    for doc_id, text, *_ in rows:
        for i, line in enumerate((text or "").split("\n")):
            p = model.probabilities(line)
            k = int(p.argmax())
            assert ((doc_id, i, model.families[k]) in found) == (k != unknown and p[k] >= 0.5), line
    assert model.bias.argmax() == unknown
    assert licenses.scan(none, licenses.fit(none)).count() == 0
    plan = licenses.scan(d, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_licences_of_a_hot_source(spark):
    """A notice below every third document does not make its own words ordinary."""
    rng = random.Random(12)
    rows = [(i, "\n".join(words(rng, 12) for _ in range(3)) + (f"\nCopyright {1990 + i % 30} Acme News. All rights reserved." if i % 3 == 0 else ""), "en", "s") for i in range(300)]
    rows += [(900 + i, f"{words(rng, 9)}\nAll rights reserved.", "en", "t") for i in range(5)]
    d = docs_of(spark, rows)
    model = licenses.fit(d)
    assert {"rights", "reserved", "copyright"} <= set(model.rare)
    assert {r.doc_id for r in licenses.scan(d, model).collect() if r.family == "proprietary"} >= {900 + i for i in range(5)}
    common = dict.fromkeys({w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)}, 1000)
    features = licenses.train(["a line of ordinary words"], common, 1000).features
    assert all(licenses.grams_of(t) & set(features) for ts in licenses.TEMPLATES.values() for t in ts)
