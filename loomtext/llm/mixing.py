"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source of integer weight n in a period of Q slots (Q: the sum of all weights) gets n blocks a
period. Its i-th block may not start before slot floor(i Q / n), its release, and has to be
placed before slot ceil((i + 1) Q / n), its deadline. Each slot takes the released block with
the earliest deadline (ties: source order). As the weights add up to one block a slot, every
deadline is met, and at each slot t a source has had less than one block more or less than
t n / Q. All sources are level again after Q slots, so the schedule of one period, made once
from the weights alone, places every block of the corpus in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_SPAN = 1 << 32
_SCHEDULE = ["block", "slot", "release", "deadline", "position"]


def shuffled(c: Column) -> Column:
    """A fixed scattering of ids over 32 bits; a source's documents are taken in this order."""
    return F.pmod(F.pmod(F.coalesce(c, F.lit(0)), F.lit(_SPAN)) * F.lit(1103515245) + F.lit(12345), F.lit(_SPAN))


def _source(c: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def target_weights(counts: DataFrame, weights: dict[str, int] | None = None, scale: int = 1000) -> DataFrame:
    """(src, n): whole weights; those given, else scale times the square root of a source's share of the rows, at least 1."""
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))  # a row for each source
    rule = F.greatest(F.lit(1), F.floor(F.lit(scale) * F.sqrt(F.col("rows").cast("double") / total))).cast("long")
    for name, n in (weights or {}).items():
        rule = F.when(F.col("src") == F.lit("=" + name), F.lit(n).cast("long")).otherwise(rule)
    return counts.select("src", rule.alias("n"))


def period(weights: DataFrame, chunk: int = 1024) -> DataFrame:
    """(src, n, q, j, slot): the slot of each source's j-th block in one period, earliest deadline first.

    The state of the fold is each source's next block (deadline, source, release, number), so a
    slot costs one look at each source; the slots taken are gathered by chunks.
    """
    whole = weights.agg(F.sort_array(F.collect_list(F.struct("src", "n"))).alias("w")).select("w", F.expr("aggregate(w, 0L, (a, x) -> a + x.n)").alias("q")).filter("q > 0")
    state = "struct<d: bigint, i: int, r: bigint, j: bigint>"
    block = "named_struct('d', (({j} + 1) * q + w[{i}].n - 1) div w[{i}].n, 'i', {i}, 'r', {j} * q div w[{i}].n, 'j', {j})"
    start = f"transform(w, (x, i) -> {block.format(i='i', j='0L')})"
    after = f"transform(a.at, x -> if(x.i = k, {block.format(i='x.i', j='(x.j + 1)')}, x))"
    slot = f"element_at(transform(array(array_min(filter(a.at, x -> x.r <= t)).i), k -> named_struct('at', {after}, 'took', concat(a.took, array(k)))), 1)"
    inner = f"aggregate(sequence(c, least(c + {chunk - 1}, q - 1)), named_struct('at', s.at, 'took', cast(array() as array<int>)), (a, t) -> {slot})"
    outer = f"element_at(transform(array({inner}), o -> named_struct('at', o.at, 'took', concat(s.took, array(o.took)))), 1)"
    took = f"flatten(aggregate(sequence(0L, q - 1, {chunk}L), named_struct('at', cast({start} as array<{state}>), 'took', cast(array() as array<array<int>>)), (s, c) -> {outer}).took)"
    slots = whole.select("w", "q", F.posexplode(F.expr(took)).alias("slot", "i")).select(F.expr("w[i].src").alias("src"), F.expr("w[i].n").alias("n"), "q", F.col("slot").cast("long").alias("slot"))
    return slots.withColumn("j", F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("long") - 1)


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = 64, tie: Column | None = None, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, source, tie and the schedule of every row: block (of its source), slot, release, deadline, position.

    Up to the slot in which a source runs out, its share of the slots so far is within one block
    of its target; its later slots stay empty, so the others keep their proportions, and every
    row is placed. Position is the row's place in the whole order, from 0 and without gaps.
    A null source is a source of its own. A null doc_id is taken as 0, rows with the same doc_id
    are ordered by ``tie`` (a hash of the text); an id that more than ``bucket_rows`` rows share
    is split by it, and what is equal then by the order in which it was read. An empty table
    gives an empty result.

    Ranks in a source come from buckets of the scattered ids (about ``bucket_rows`` rows each,
    at any size of a source), totals of the buckets before, and the rank inside.
    """
    light = written(docs.select("doc_id", "source", _source().alias("src"), shuffled(F.col("doc_id")).alias("mix"), (F.xxhash64("text") if tie is None else tie).alias("tie"), F.monotonically_increasing_id().alias("read")), "mix-rows")
    n_rows = light.count()
    buckets = max(1, n_rows // bucket_rows)
    rows = light.withColumn("bucket", F.shiftright(F.col("mix") * F.lit(buckets), 32)).withColumns({"hot": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    sizes = written(rows.groupBy("src", "bucket", "hot", "part").agg(F.count("*").alias("rows")), "mix-buckets")
    full = sizes.filter(F.col("rows") > 8 * bucket_rows)
    if full.limit(1).count():  # ids that many rows share
        common = rows.join(full.select("src", "bucket"), ["src", "bucket"], "left_semi").groupBy("src", "mix").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
        rows = rows.join(written(common.select("src", "mix", F.lit(True).alias("split")), "mix-common"), ["src", "mix"], "left")
        rows = rows.withColumns({"hot": F.when(F.col("split"), F.col("mix")).otherwise(F.lit(-1)), "part": F.when(F.col("split"), F.shiftright("tie", 54) * 1024 + F.pmod("read", F.lit(1024))).otherwise(0)}).drop("split")
        # In a bucket the rows that are not split come first.
        sizes = written(rows.groupBy("src", "bucket", "hot", "part").agg(F.count("*").alias("rows")), "mix-buckets")
    total = sizes.groupBy("src", "bucket").agg(F.sum("rows").alias("all"))
    of_bucket = total.withColumn("first", F.sum("all").over(Window.partitionBy("src").orderBy("bucket")) - F.col("all")).drop("all")
    inner = F.sum("rows").over(Window.partitionBy("src", "bucket").orderBy("hot", "part")) - F.col("rows")
    before = sizes.withColumn("inner", inner).join(of_bucket, ["src", "bucket"]).select("src", "bucket", "hot", "part", (F.col("first") + F.col("inner")).alias("before"))
    plan = written(period(target_weights(sizes.groupBy("src").agg(F.sum("rows").alias("rows")), weights)), "mix-period")
    of = plan.select("src", "n", "q").distinct()
    inside = F.row_number().over(Window.partitionBy("src", "bucket", "hot", "part").orderBy("mix", F.col("doc_id"), "tie", "read")) - 1
    ranked = rows.withColumn("inside", inside).join(written(before.join(of, "src"), "mix-before"), ["src", "bucket", "hot", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    block = ranked.withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("j", F.expr("block % n"))
    placed = block.join(plan.select("src", "j", F.col("slot").alias("at")), ["src", "j"]).select(
        "doc_id", "source", "tie", "rank", "block",
        F.expr("(block div n) * q + at").alias("slot"), F.expr("block * q div n").alias("release"), F.expr("((block + 1) * q + n - 1) div n").alias("deadline"),
    )
    placed = written(placed, "mix-placed")
    filled = placed.groupBy("slot").agg(F.count("*").alias("rows")).withColumn("chunk", F.expr("slot div 1024"))
    chunks = filled.groupBy("chunk").agg(F.sum("rows").alias("rows"))
    chunks = chunks.select("chunk", (F.sum("rows").over(Window.orderBy("chunk")) - F.col("rows")).alias("chunk_before"))  # a row for 1024 blocks
    starts = filled.join(chunks, "chunk").select("slot", (F.col("chunk_before") + F.sum("rows").over(Window.partitionBy("chunk").orderBy("slot")) - F.col("rows")).alias("start"))
    return placed.join(starts, "slot").select("doc_id", "source", "tie", "block", "slot", "release", "deadline", (F.col("start") + F.expr(f"rank % {block_rows}")).alias("position"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = 64) -> DataFrame:
    """All rows of ``docs`` in scheduled order: partitions and the rows in them follow the position."""
    names = docs.columns
    tagged = docs.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    at = written(schedule(tagged, weights, block_rows, tie=F.col("__tie")).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("position").alias("__position")), "mix-positions")
    same = at.groupBy("__id", "__tie").agg(F.count("*").alias("n")).filter("n > 1")
    if same.limit(1).count():  # rows repeated whole: one of each, then as often as it was there
        tagged = tagged.dropDuplicates(["doc_id", "__tie"])
    found = tagged.join(at.withColumnRenamed("__tie", "__t"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__t")))
    return found.repartitionByRange("__position").sortWithinPartitions("__position").select(*[F.col(f"`{c}`") for c in names])


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, (((coalesce(doc_id, 0) % 4294967296 + 4294967296) % 4294967296) * 1103515245 + 12345) % 4294967296 AS mix FROM documents),
w AS (SELECT src, greatest(1, floor(1000 * sqrt(count(*)::DOUBLE / (SELECT count(*) FROM d))))::BIGINT AS n FROM d GROUP BY src),
p AS (SELECT list(src ORDER BY src) AS ss, list(n ORDER BY src) AS ns, sum(n)::BIGINT AS q FROM w),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(ns, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick FROM p
  UNION ALL
  SELECT t + 1, list_transform(had, lambda v, i: v + CASE WHEN i = k THEN 1 ELSE 0 END), k
  FROM (SELECT t, had, list_min(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN had[i] * q // ns[i] <= t THEN (((had[i] + 1) * q + ns[i] - 1) // ns[i]) * 1000000 + i END)) % 1000000 AS k FROM edf, p WHERE t < q)),
plan AS (SELECT ss[pick] AS src, ns[pick] AS n, q, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf, p WHERE t > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY mix, doc_id) - 1 AS rank FROM d),
b AS (SELECT r.*, rank // 64 AS block, n, q FROM r JOIN (SELECT DISTINCT src, n, q FROM plan) USING (src))
SELECT doc_id, source, block, (block // b.n) * b.q + place AS slot, block * b.q // b.n AS release, ((block + 1) * b.q + b.n - 1) // b.n AS deadline,
  row_number() OVER (ORDER BY (block // b.n) * b.q + place, rank) - 1 AS position
FROM b JOIN plan ON b.src = plan.src AND plan.j = block % b.n
"""
