"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Every query runs whole, from its input files to its last
row, into a sink that discards them; the better of two runs counts, so that JVM
warm-up does not.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hedgewatch.checks.all_queries import QUERIES  # noqa: E402
from hedgewatch.session import local_session  # noqa: E402

HEADLINE = (
    "access_log_auto", "log_directory_scan", "rule_detection", "flagged_by_severity",
    "canonical_key_log", "canonical_key_pages", "nearest_entry", "exact_lookup",
    "batch_exact_hits", "verdict_parsing", "search_free_text", "page_by_score",
    "session_metrics", "latency_p95", "tfidf_vocabulary", "threshold_sweep", "session_run",
    "batch_reuse_replay", "incremental_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="12g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
        "lines_per_second": {n: round(lines / seconds[n]) for n in ("access_log_auto", "rule_detection", "flagged_by_severity", "session_run")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
