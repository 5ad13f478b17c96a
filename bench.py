"""Headline timings: python bench.py prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from granthi.plans.queries import REGISTRY
from granthi.session import local_session

HEADLINE = [
    "bm25_topk", "dense_topk", "hybrid_topk", "page_clean", "chunk_pages", "exact_dedup",
    "verbatim_runs", "answer_batch", "identifier_boost", "doc_rollup", "tariff_by_product",
    "daily_usage", "cap_admission", "indexed_bm25_topk", "build_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    REGISTRY["query_terms"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
