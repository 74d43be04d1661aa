"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner products become least distances by one more component: every vector gets
sqrt(M^2 - |x|^2), M being the largest length, and a query gets 0. Gaussian projections (a
2-stable distribution) to ``DIM`` dimensions keep squared distances up to a chi-square factor
of DIM degrees of freedom. A query takes projected neighbours in ascending order from a
kd-tree, verifies their true inner products, and stops when the projected distance of what is
left exceeds the distance of its k-th best by more than the chi-square quantile ``sure``: a
true neighbour is then left out with a probability of at most 1 - sure.

The rows are spread over cells of a top tree fitted on a bounded sample; cells with many rows
are split by a hash into chunks of bounded size. A query first searches its own cell, and then
only the chunks whose box passes the same stopping test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DIM = 6
#: Boxes are sent to all executors; beyond this number chunks grow instead (about 100 bytes a box). That is at 10^9 rows
#: of the default chunk size; at 10^10 a chunk has 152,000 rows, 80 MB at 64 components.
MOST_BOXES = 1 << 16
_FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, dim: int = DIM) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dim // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return lo


class Projection:
    """The random lines and the top tree's cuts."""

    def __init__(self, width: int, longest: float, sample: np.ndarray, cells: int, seed: int = 11):
        self.lines = np.random.default_rng(seed).normal(size=(width + 1, DIM))
        self.longest, self.cuts = longest, []
        self._cut(self(sample), cells, self.cuts)
        self.cells = max(1, cells)

    def _cut(self, p: np.ndarray, cells: int, cuts: list) -> None:
        """Preorder list of (dimension, value, cells below); median cuts along the widest spread."""
        if cells < 2:
            return
        d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
        v = float(np.median(p[:, d])) if len(p) else 0.0
        at = len(cuts)
        cuts.append(None)
        self._cut(p[p[:, d] <= v], cells // 2, cuts)
        right = len(cuts)
        self._cut(p[p[:, d] > v], cells - cells // 2, cuts)
        cuts[at] = (d, v, right)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return x @ self.lines[:-1] + rest[:, None] * self.lines[-1]

    def cell(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)

        def walk(at: int, cells: int, first: int, who: np.ndarray) -> None:
            if cells < 2:
                out[who] = first
                return
            d, v, right = self.cuts[at]
            low = p[who, d] <= v
            walk(at + 1, cells // 2, first, who[low])
            walk(right, cells - cells // 2, first + cells // 2, who[~low])

        walk(0, self.cells, 0, np.arange(len(p)))
        return out


class KdTree:
    """Leaves of at most ``leaf`` points with their boxes; neighbours come leaf by leaf in the order of the boxes' distance."""

    def __init__(self, p: np.ndarray, leaf: int = 128):
        self.p, self.leaves = p, []
        todo = [np.arange(len(p))]
        while todo:
            who = todo.pop()
            spread = np.ptp(p[who], axis=0)
            if len(who) <= leaf or not spread.max():
                self.leaves += [who[i : i + leaf] for i in range(0, len(who), leaf)]
                continue
            order = who[np.argsort(p[who, int(np.argmax(spread))], kind="stable")]
            todo += [order[: len(who) // 2], order[len(who) // 2 :]]
        self.flat = np.concatenate(self.leaves)
        self.low = np.array([p[w].min(axis=0) for w in self.leaves])
        self.high = np.array([p[w].max(axis=0) for w in self.leaves])

    def points(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([self.leaves[i] for i in leaves]) if len(leaves) < len(self.leaves) else self.flat


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=-1)


class BoxTree:
    """Boxes in the order of their cells under boxes of ``fan`` neighbours each, level by level; a query descends into what is near enough."""

    def __init__(self, low: np.ndarray, high: np.ndarray, fan: int = 16):
        self.fan, self.levels = fan, [(low, high)]
        while len(low) > fan:
            cuts = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.insert(0, (low, high))

    def within(self, q: np.ndarray, limit: float) -> np.ndarray:
        """Numbers of the boxes at a squared distance of ``limit`` or less."""
        at = np.arange(len(self.levels[0][0]))
        for depth, (low, high) in enumerate(self.levels):
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(low)]
            at = at[_box_distance(q, low[at], high[at]) <= limit]
        return at

    def nearest(self, q: np.ndarray) -> int:
        at = np.arange(len(self.levels[0][0]))
        for depth, (low, high) in enumerate(self.levels):  # a box at hand, then all that are nearer
            if depth:
                at = np.arange(best * self.fan, min(len(low), (best + 1) * self.fan))
            far = _box_distance(q, low[at], high[at])
            best = int(at[np.argmin(far)])
        near = self.within(q, float(far.min()))
        low, high = self.levels[-1]
        return int(near[np.argmin(_box_distance(q, low[near], high[near]))])


def search(ids, x, p, qids, qx, qp, bounds, k: int, longest: float, quantile: float) -> list[tuple[int, int, float]]:
    """(query, vector, inner product) of each query's best k among x; bounds: inner products already reached, or -inf."""
    tree, out = KdTree(p), []
    for qid, q, pq, bound in zip(qids, qx, qp, bounds):
        far = _box_distance(pq, tree.low, tree.high)
        length = longest**2 + float(q @ q)
        best, best_s, reach = np.zeros(0, np.int64), np.zeros(0), bound
        order = np.argsort(far, kind="stable")
        sorted_far, done, batch = far[order], 0, 4
        while done < len(order):
            # true squared distance of the k-th best: M^2 + |q|^2 - 2 (x, q)
            limit = quantile * max(0.0, length - 2 * reach) if reach > -np.inf else np.inf
            if sorted_far[done] > limit:
                break
            take = order[done : min(done + batch, int(np.searchsorted(sorted_far, limit, "right")))]
            done, batch = done + len(take), batch * 3
            who = tree.points(take)
            gap = p[who] - pq
            who = who[(np.einsum("ij,ij->i", gap, gap) <= limit) & (ids[who] != qid)]
            rough = x[who] @ q
            who = who[rough >= reach - 1e-9 * (length + 1)]  # exact values only for what may count
            if not len(who):
                continue
            best, best_s = np.concatenate([best, who]), np.concatenate([best_s, (x[who] * q).sum(axis=1)])
            if len(best) > k:
                keep = np.lexsort((ids[best], -best_s))[:k]
                best, best_s = best[keep], best_s[keep]
            if len(best) == k:
                reach = max(reach, float(best_s.min()))
        out += [(int(qid), int(i), float(v)) for i, v in zip(ids[best], best_s) if v >= bound]
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sure: float = 0.95, cell_rows: int = 8192, chunk_rows: int = 16_384, query_rows: int = 4096, sample_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows whose vec_id ``every`` divides, their k largest inner products.

    ``vectors`` has vec_id and embedding. Vectors that are null or zero or hold null or
    non-finite components, and rows without vec_id, take no part. A query's candidates are all
    rows with another vec_id; ties go to the smaller vec_id; fewer than k candidates are all
    returned. A vec_id that repeats counts once if its rows are the same. Vectors of another
    length than the most common are left out, as no product is defined. An empty table gives
    an empty result; other columns are ignored.

    ``sample_rows`` bounds the sample that the top tree is fitted on; every row is indexed.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", e.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good).distinct()
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    width, n, longest = widths.w, widths.n, math.sqrt(widths.m)
    chunk_rows = max(chunk_rows, n // MOST_BOXES)
    rows = rows.filter(F.size("x") == width)
    share = F.lit(min(1 << 30, (1 << 30) * sample_rows // n))
    sample = sorted(tuple(r[0]) for r in rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) < share).select("x").collect())
    sent = spark.sparkContext.broadcast(Projection(width, longest, np.array(sample).reshape(-1, width), min(4096, max(1, n // cell_rows))))
    quantile = chi_square_quantile(sure)

    def place(frames):
        for f in frames:
            x = np.stack(f["x"].to_numpy()) if len(f) else np.zeros((0, width))
            p = sent.value(x)
            is_query = (f["vec_id"].to_numpy() % every) == 0
            pq = sent.value(x, query=True)
            yield f.assign(p=list(p), cell=sent.value.cell(p), home=np.where(is_query, sent.value.cell(pq), -1), pq=list(pq))

    placed = written(rows.mapInPandas(place, "vec_id long, x array<double>, p array<double>, cell long, home long, pq array<double>"), "ann-placed")
    # Chunks of bounded size: a full cell is split by a hash of the id.
    pieces = placed.groupBy("cell").agg(F.count("*").alias("rows")).withColumn("pieces", F.expr(f"(rows + {chunk_rows - 1}) div {chunk_rows}"))
    chunked = placed.join(F.broadcast(pieces.select("cell", "pieces")), "cell").withColumn("chunk", F.col("cell") * F.lit(1 << 20) + F.pmod(F.xxhash64("vec_id"), "pieces"))
    chunked = written(chunked.select("chunk", "cell", "vec_id", "x", "p"), "ann-chunks")
    bounds = [F.struct(*[f(F.col("p")[i]).alias(f"_{i}") for i in range(DIM)]).alias(nm) for f, nm in ((F.min, "low"), (F.max, "high"))]
    boxes = sorted((r.chunk, r.cell, tuple(r.low), tuple(r.high)) for r in chunked.groupBy("chunk", "cell").agg(*bounds).collect())  # a row for each chunk
    homes = {}
    for chunk, cell, *_ in boxes:
        homes.setdefault(cell, []).append(chunk)
    queries = placed.filter("home >= 0").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), "pq", "home")
    box = spark.sparkContext.broadcast((np.array([b[0] for b in boxes]), BoxTree(np.array([b[2] for b in boxes]), np.array([b[3] for b in boxes])), homes))

    def visit(asked: DataFrame) -> DataFrame:
        """Searches each (chunk, query) with its bound; a chunk's queries go in blocks, for each of which its rows are read."""
        blocks = written(asked.groupBy("chunk").agg(F.count("*").alias("asked")).withColumn("blocks", F.expr(f"(asked + {query_rows - 1}) div {query_rows}")).select("chunk", "blocks"), "ann-blocks")
        data = chunked.join(blocks, "chunk").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
        asked = asked.join(blocks, "chunk").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))

        def run(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(d) or not len(q):
                return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
            s = lambda c: np.stack(c.to_numpy())
            got = search(d["vec_id"].to_numpy(), s(d["x"]), s(d["p"]), q["query_id"].to_numpy(), s(q["q"]), s(q["pq"]), q["bound"].to_numpy(), k, longest, quantile)
            return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

        return data.select("chunk", "block", "vec_id", "x", "p").groupBy("chunk", "block").cogroup(asked.select("chunk", "block", "query_id", "q", "pq", "bound").groupBy("chunk", "block")).applyInPandas(run, _FOUND)

    def at_home(frames):
        chunks, tree, own = box.value
        for f in frames:
            out = []
            for home, pq in zip(f["home"], f["pq"]):
                near = own.get(home)
                # of a split home cell, or if it is empty, the chunk whose box is nearest
                out.append(near[0] if near else int(chunks[tree.nearest(np.asarray(pq))]))
            yield f.assign(chunk=np.array(out, np.int64), bound=-np.inf)

    kind = "query_id long, q array<double>, pq array<double>, home long, chunk long, bound double"
    first = written(queries.mapInPandas(at_home, kind), "ann-first")
    got = written(visit(first), "ann-home")
    reached = got.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("reached"))

    def onward(frames):
        chunks, tree, _ = box.value
        for f in frames:
            out = []
            for i, (q, pq, chunk, reach) in enumerate(zip(f["q"], f["pq"], f["chunk"], f["reached"])):
                limit = quantile * max(0.0, longest**2 + float(np.dot(q, q)) - 2 * reach) if reach > -np.inf else np.inf
                out += [(i, c) for c in chunks[tree.within(np.asarray(pq), limit)].tolist() if c != chunk]
            at = np.array([o[0] for o in out], np.int64)
            g = f.iloc[at].assign(chunk=np.array([o[1] for o in out], np.int64))
            yield g.assign(bound=g["reached"])[["query_id", "q", "pq", "home", "chunk", "bound"]]

    second = first.join(reached, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(float("-inf"))))
    rest = visit(written(second.mapInPandas(onward, kind), "ann-second"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.union(rest).distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
