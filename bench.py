"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "flagship_hybrid_search", "tokenize_counts", "line_window_chunks", "hash_embedding_sparse", "bm25_topk", "bm25_prefix", "vector_topk", "reference_containing_chunk",
    "graph_edges_by_type", "graph_two_hop", "graph_expansion_dedupe", "bundle_pack", "incremental_diff", "scan_decisions", "debounce_sessions",
)


def main() -> None:
    from tessera.jobs import registry
    from tessera.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    with tempfile.TemporaryDirectory() as folder:
        spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), folder)
        registry.QUERIES["status_counts"](spark, "/root/testdata/sf0.001").collect()  # start the JVM's compilers
        times = {}
        for name in HEADLINE:
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
