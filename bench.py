"""Run the headline queries once cold and three times warm; print one JSON line.

BENCH_SF_DIR: the tables (default sf0.1). BENCH_CPUS: cores (default 8). Results go to the noop sink, so the whole plan runs
and nothing is collected. `value` adds up the warm medians.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path[:0] = [str(Path(__file__).resolve().parent)]

from contactmill.plans import catalogue  # noqa: E402
from contactmill.session import build_session  # noqa: E402

HEADLINE = (
    "lead_score", "lead_filter_page", "lead_stats", "top_funds", "freshness_stats", "pattern_source_stats", "merge_fold", "two_level_dedupe", "lead_upsert", "delta_anti_join", "provider_waterfall",
    "pattern_candidates", "pattern_confidence", "status_cascade", "normalize_fund", "content_hash_dups", "recrawl_priority", "running_balance", "failure_runs", "email_extract",
)
WARM = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}

    def once(name: str) -> float:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in HEADLINE:
        cold[name] = round(once(name), 4)
        warm[name] = round(median(once(name) for _ in range(WARM)), 4)
    print(json.dumps({"metric": "sum of warm medians, headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
