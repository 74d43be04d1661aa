"""Times the headline queries and index builds and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from loomtext.operators.index import PositionalIndex
from loomtext.operators.pipeline import PIPELINES
from loomtext.plans import catalog
from loomtext.session import get_spark, scratch
from loomtext.sources.sinks import load_index, save_index

HEADLINE = ["clean_glue", "html_strip", "tok_custom", "token_counts_by_tokenizer", "postings_df_cf", "idf_tfidf", "stage_counts", "rank_tfidf", "search_phrase", "search_nested", "ngram_2", "collocation_2", "doc_stats", "zipf_slope", "heaps_points", "retrieval_metrics", "ground_cosine", "gazetteer_match", "dialogue_to_text", "bpe_top_pair"]
#: Index builds from text to sorted postings on disk, by pipeline; the published builds are of these.
BUILDS = ["A", "B", "H2"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus), spark__driver__memory="8g")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # the session's own start is not measured
    took, builds, entries = {}, {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr)
    for name in BUILDS:
        start, folder = time.perf_counter(), scratch(spark, f"bench-{name}")
        save_index(PositionalIndex.build(catalog.docs(spark, sf_dir), PIPELINES[name]), folder)
        builds[name] = round(time.perf_counter() - start, 3)
        entries[name] = load_index(spark, folder, PIPELINES[name]).postings.count()
        print("build", name, builds[name], entries[name], round(entries[name] / builds[name]), "entries/s", file=sys.stderr)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2], "builds": builds, "entries": entries}))


if __name__ == "__main__":
    main()
