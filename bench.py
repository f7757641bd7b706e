"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each.

Each query runs once to warm up and is then timed (median of BENCH_RUNS, default 3), writing every row to a sink
that discards it, so that no column can be pruned away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "chunk_docs", "version_chain", "merge_state", "vector_search_batch", "page_text", "page_metadata", "snapshot_diff",
    "poll_changes", "debounce", "throttle", "search_rows", "match_existing", "latest_doc", "list_docs", "chunks_equal",
    "bag_overlap", "segment_posts", "first_seen_dedup", "containment_dedup", "route_pages", "knn_exact", "embed_text",
    "text_search", "parse_metric", "embed_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pagevault.plans import all_queries
    from pagevault.session import local_session

    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
