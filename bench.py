"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lexora.plans import catalogue
from lexora.session import build_session

HEADLINE = [
    "consensus_winner", "consensus_sweep", "text_match_docs", "ranked_search", "lookup_bulk", "exact_picker", "dup_name_groups", "trigram_fuzzy", "alias_conflicts",
    "unmet_gap_top10", "locale_gap_unpivot", "catalogue_breakdown", "trust_tier_coverage", "silent_lanes", "change_feed", "interval_overlap", "provider_listagg",
    "fingerprints_diff", "sla_latency", "readiness_funnel", "norm_keys", "intake_gate", "html_clean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, shuffle=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            now = time.perf_counter() - began
            best = now if best is None else min(best, now)
        took[name] = round(best, 3)
        print(f"{name}: {best:.2f} s", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
