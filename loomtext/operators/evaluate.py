"""Scores: precision and recall, agreement, spans, ranked retrieval, tags and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds precision, recall and f1, four places, zero where undefined."""
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return df.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1(p, r), 4)})


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: kappa of two judges; 1 if chance agreement is certain."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("a").agg(F.sum("n").alias("x"))
    right = cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return n.join(F.broadcast(chance)).select(F.when(pe == 1, 1.0).otherwise(F.round((po - pe) / F.when(pe == 1, 1.0).otherwise(1 - pe), 4)).alias("kappa"))


def boundary_scores(gold: DataFrame, pred: DataFrame, group: str | None = None) -> DataFrame:
    """Exact spans: both tables have id, start, end (and ``group``); micro sums, and the share of sentences all right."""
    keys = ["id", "start", "end"]
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = pred.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full_outer").withColumns({"tp": (F.col("g").isNotNull() & F.col("p").isNotNull()).cast("int"), "fp": F.col("g").isNull().cast("int"), "fn": F.col("p").isNull().cast("int")})
    per = both.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if group:
        per = per.join(gold.select("id", group).distinct(), "id")
        per = per.groupBy(group)
    else:
        per = per.groupBy()
    return prf(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.round(F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")), 4).alias("sentence_exact_match")))


def retrieval_scores(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """A row for each query of ``qrels`` (qid, doc_id, relevant) or ``ranked`` (qid, doc_id, rank): P, R, F1, P@k, R@k, AP."""
    rel = qrels.filter("relevant = 1").select("qid", "doc_id", F.lit(1).alias("hit"))
    n_rel = rel.groupBy("qid").agg(F.count("*").alias("relevant"))
    hits = ranked.join(rel, ["qid", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    run = hits.withColumn("so_far", F.sum("hit").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    at = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks]
    per = run.groupBy("qid").agg(F.count("*").alias("retrieved"), F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"), *at)
    q = qrels.select("qid").union(ranked.select("qid")).distinct().join(per, "qid", "left").join(n_rel, "qid", "left").fillna(0)
    none = F.col("relevant") == 0
    p = F.when(F.col("retrieved") == 0, none.cast("double")).otherwise(ratio(F.col("hits"), F.col("retrieved")))
    r = ratio(F.col("hits"), F.col("relevant"), 1.0)
    cols = [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"), "retrieved", "relevant", "hits"]
    for k in ks:
        cols += [F.round(F.col(f"h{k}") / k, 4).alias(f"p_at_{k}"), F.round(ratio(F.col(f"h{k}"), F.col("relevant"), 1.0), 4).alias(f"r_at_{k}")]
    return q.select("qid", *cols, F.round(ratio(F.col("ap_sum"), F.col("relevant"), 1.0), 4).alias("ap"))


def dense_qrels(docs: DataFrame, queries: list[str], sparse: DataFrame) -> DataFrame:
    """(doc_id, qid, relevant) for each document and each of a stated list of queries; ``sparse`` has the rows above zero."""
    grid = docs.select("doc_id", F.explode(F.array(*map(F.lit, queries))).alias("qid"))
    return grid.join(sparse, ["doc_id", "qid"], "left").select("doc_id", "qid", F.coalesce("relevant", F.lit(0)).alias("relevant"))


def curve_at_k(ranked: DataFrame, qrels: DataFrame, kmax: int = 10) -> DataFrame:
    """(k, p, r): precision and recall at each cut-off, averaged over the queries of ``qrels``."""
    rel = qrels.filter("relevant = 1").select("qid", "doc_id")
    n_rel = rel.groupBy("qid").agg(F.count("*").alias("relevant"))
    hits = ranked.filter(F.col("rank") <= kmax).join(rel, ["qid", "doc_id"], "left_semi").select("qid", "rank")
    grid = qrels.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(1), F.lit(kmax))).alias("k"))
    per = grid.join(hits, "qid", "left").groupBy("qid", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("h")).join(n_rel, "qid", "left").fillna(0, ["relevant"])
    # Means of ten-thousandths as whole numbers: they don't depend on the order of the queries.
    mean = lambda x: F.round(F.sum(F.round(x * 10_000).cast("long")) / F.count("*") / 10_000, 4)
    return per.groupBy("k").agg(mean(F.col("h") / F.col("k")).alias("p"), mean(ratio(F.col("h"), F.col("relevant"), 1.0)).alias("r"))


def tagging_accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.agg(F.count("*").alias("tokens"), F.count_if(F.col(gold) == F.col(pred)).alias("correct")).withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("tokens")), 4))


def top_errors(df: DataFrame, gold: str, pred: str, k: int = 15) -> DataFrame:
    wrong = df.filter(F.col(gold) != F.col(pred)).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("count"))
    return wrong.orderBy(F.desc("count"), "gold", "pred").limit(k)


def confusion_matrix(df: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """A row for each label with a column ``pred_<label>`` for each; unknown labels are ignored, absent pairs are 0."""
    spark = df.sparkSession
    known = df.filter(F.col(gold).isin(labels) & F.col(pred).isin(labels))
    wide = known.groupBy(F.col(gold).alias("gold")).agg(*[F.count_if(F.col(pred) == v).alias(f"pred_{v}") for v in labels])
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("gold"))
    return rows.join(F.broadcast(wide), "gold", "left").fillna(0)


_ENTITY = "struct<ord: int, start: int, end: int, label: string>"


def ner_rows(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, start, end, label, predicted, status) of every gold entity and every spurious prediction.

    Both tables have id, ord, start, end, label. In the order of the gold entities: an exact
    match is correct, else the first free overlapping prediction makes it incorrect, else it is
    missed; predictions that overlap nothing are spurious. The order matters, so a sentence's
    entities are folded as two sorted arrays.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("ord", "int"), ("start", "int"), ("end", "int"), ("label", "string"))]))).alias(name))

    none = F.array().cast(f"array<{_ENTITY}>")
    both = listed(gold, "g").join(listed(pred, "p"), "id", "full_outer").select("id", F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    cross = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    out = "array<struct<start: int, end: int, label: string, predicted: string, status: string>>"

    def step(acc, e):
        exact = F.filter("p", lambda x: (x["start"] == e["start"]) & (x["end"] == e["end"]) & (x["label"] == e["label"]))
        near = F.filter("p", lambda x: cross(x, e) & ~F.array_contains(acc["used"], x["ord"]))
        hit = F.when(F.size(exact) > 0, exact[0]).when(F.size(near) > 0, near[0])
        status = F.when(F.size(exact) > 0, "correct").when(hit.isNotNull(), "incorrect").otherwise("missed")
        row = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), hit["label"].alias("predicted"), status.alias("status"))
        used = F.when(hit.isNotNull(), F.concat(acc["used"], F.array(hit["ord"]))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["rows"], F.array(row)).cast(out).alias("rows"))

    folded = both.withColumn("a", F.aggregate("g", F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(out).alias("rows")), step))
    extra = F.transform(F.filter("p", lambda x: ~F.array_contains("a.used", x["ord"]) & ~F.exists("g", lambda e: cross(x, e))), lambda x: F.struct(x["start"], x["end"], F.lit(None).cast("string"), x["label"], F.lit("spurious"))).cast(out)
    return folded.select("id", F.explode(F.concat("a.rows", extra)).alias("r")).select("id", "r.*")


def ner_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, gold, predicted, correct, incorrect, missed, spurious, precision, recall, f1); label ``ALL`` sums up."""
    rows = ner_rows(gold, pred).withColumn("label", F.coalesce("label", "predicted"))
    kinds = ["correct", "incorrect", "missed", "spurious"]
    c = rows.rollup("label").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds]).withColumn("label", F.coalesce("label", F.lit("ALL")))
    c = c.withColumns({"gold": F.col("correct") + F.col("incorrect") + F.col("missed"), "predicted": F.col("correct") + F.col("incorrect") + F.col("spurious")})
    p, r = ratio(F.col("correct"), F.col("predicted")), ratio(F.col("correct"), F.col("gold"))
    return c.select("label", "gold", "predicted", *kinds, F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"))


def ner_comparison(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, start, end, label, predicted_1, status_1, predicted_2, status_2): what two systems make of each gold entity."""
    keys = ["id", "start", "end", "label"]
    one, two = (ner_rows(gold, p).filter("status <> 'spurious'").select(*keys, F.col("predicted").alias(f"predicted_{i}"), F.col("status").alias(f"status_{i}")) for i, p in ((1, first), (2, second)))
    return one.join(two, keys, "full_outer")


def lemma_accuracy(gold: DataFrame, lemmatizers: dict) -> DataFrame:
    """(lemmatizer, tokens, correct, accuracy, errors): lemmas of alphabetic words of (token, lemma) under each function of a column.

    errors has the eight commonest as ``token->lemma (gold lemma)``, ties by the text.
    """
    words = gold.filter(F.col("token").rlike(r"^\p{L}+$")).groupBy("token", "lemma").agg(F.count("*").alias("n"))
    out = None
    for name, lemma in lemmatizers.items():
        one = words.select(F.lit(name).alias("lemmatizer"), "token", F.lower("lemma").alias("lemma"), "n", F.lower(lemma(F.lower("token"))).alias("own"))
        out = one if out is None else out.union(one)
    right = F.col("own") == F.col("lemma")
    wrong = out.filter(~right).groupBy("lemmatizer", F.concat("token", F.lit("->"), "own", F.lit(" (gold "), "lemma", F.lit(")")).alias("e")).agg(F.sum("n").alias("n"))
    wrong = wrong.withColumn("r", F.row_number().over(Window.partitionBy("lemmatizer").orderBy(F.desc("n"), "e"))).filter("r <= 8")
    wrong = wrong.groupBy("lemmatizer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "e"))), lambda x: x["e"]), "; ").alias("errors"))
    sums = out.groupBy("lemmatizer").agg(F.sum("n").alias("tokens"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("correct"))
    return sums.join(F.broadcast(wrong), "lemmatizer", "left").select("lemmatizer", "tokens", "correct", F.round(ratio(F.col("correct"), F.col("tokens")), 4).alias("accuracy"), F.coalesce("errors", F.lit("")).alias("errors"))


def median(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """(by, median) of a column, the mean of the two middle values where there are two."""
    return df.groupBy(*([by] if by else [])).agg(F.median(c).alias("median"))


def select_pipeline(scores: DataFrame) -> DataFrame:
    """The winner of (name, f1, p_at_5, fidelity, vocabulary, posthoc): post-hoc runs are not eligible."""
    return scores.filter(~F.col("posthoc")).orderBy(F.desc("f1"), F.desc("p_at_5"), F.desc("fidelity"), "vocabulary", "name").limit(1)
