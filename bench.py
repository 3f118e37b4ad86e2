"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from strandloom.plans import catalog
from strandloom.session import build_session

HEADLINE = ["base_counts_per_locus", "significant_loci", "significant_loci_deep", "mate_dedup", "read_pair_overlap", "match_histogram", "pair_log_ratio_sum", "similarity_add_min", "laplacian", "cluster_genotypes", "variant_lines", "common_variants", "cell_scores", "em_one_step"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, "16g", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        for _ in range(2):  # the second run is warm
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
