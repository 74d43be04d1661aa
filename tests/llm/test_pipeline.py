"""The corpus pipeline's stages against brute force on the smallest tables."""

import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomtext.llm import decontaminate
from loomtext.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and all(d.columns == columns for d in seen[:-1])
    assert len(ids[1]) > 0.8 * len(ids[0]) and ids[3] == ids[4] == ids[5]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    assert len(ids[1] & toxic) < len(ids[0] & toxic)
    # the shards follow the order in which mixing wrote its rows
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(((r.f, r.i, r.doc_id, r.text) for r in seen[4].selectExpr("_metadata.file_name as f", "_metadata.row_index as i", "doc_id", "text").collect()))
    start = 0
    for (_, _, doc_id, text), r in zip(order, seen[5].orderBy("start").collect(), strict=True):
        ids_ = [*lib.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes()))
        start += len(ids_)


#: Extra columns under names that the stages use inside.
CLASHES = ("key", "fp", "of", "best", "row", "id", "h", "score", "start", "number", "position", "slot", "block", "src", "tie", "at", "digest", "f", "r")


def odd_rows(spark):
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    other, long = (" ".join(word() for _ in range(n)) for n in (60, 60_000))
    odd = [(None, None, None, None, None)] * 2 + [(None, other, None, "s", None), (9001, None, "en", "s", 0), (9002, "", "en", None, 0), (9003, "  \n", None, "s", 3), base[0], base[0], (base[1][0], other + " x", "en", "s", 9), (9004, long, "en", "s", len(long))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in base + odd], schema)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, rows repeated whole, an id with two texts, columns under clashing names: read from files and from memory."""
    docs = odd_rows(spark)
    whole = lambda d: collections.Counter(tuple(r) for r in d.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for source in (docs, written(docs, "odd")):
            out = stage(spark, source, SF)
            assert out.columns == docs.columns, name
            before, after = whole(docs), whole(out)
            assert all(after[k] <= before[k] for k in after), name
            if name == "mixing":
                assert after == before
            if name == "decontamination":
                index = decontaminate.SeedIndex([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
                assert after == collections.Counter({k: n for k, n in before.items() if not index.find(k[1])})
            if name == "near_duplicates":
                ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
                first, second = (r[0] for r in docs.select("doc_id").limit(2).collect())
                assert ids[None] == 3 and ids[first] <= 1 and ids[second] == 2  # rows without id and with other texts stay, repeated ones leave one
                assert {9001, 9002, 9003} & set(ids) == {9001}
    for source in (docs, written(docs, "odd")):
        got = corpus_pipeline.STAGES[-1][1](spark, source, SF).orderBy("start").collect()
        assert len(got) == docs.count() and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        assert sum(r.n_tokens == 1 for r in got) == 4  # null and empty texts have the end id only


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
