"""Times the headline queries on one data directory and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from docloom.plans import catalogue
from docloom.session import local_session

HEADLINE = [
    "bm25_topk", "bm25_filtered", "dense_topk", "rrf_fusion", "list_documents", "prune_versions", "manifest_diff", "upsert_latest",
    "clean_lines", "repeated_lines", "content_hash_ids", "quote_location_unique", "rank_metrics", "paired_compare", "token_f1",
    "recursive_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors' threads before the first query is timed
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("/sf")[2]}))


if __name__ == "__main__":
    main()
