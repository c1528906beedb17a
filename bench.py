"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "data_profile", "categorical_summary", "outlier_iqr", "pearson_pairs", "spearman_pairs", "mann_whitney_u", "chi2", "match_edges", "match_components", "duplicate_groups", "paper_selection", "claim_admission",
    "canonical_selection", "field_conflicts", "quality_counters", "quality_gate", "latest_per_group", "keyset_page", "versions_of_run", "lag_features", "sigma_clip", "periodogram", "robust_zscore", "graph_integrity", "event_fold", "chunk_fold", "url_normalize",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = os.pathsep.join([here, *filter(None, [os.environ.get("PYTHONPATH")])])
    from starledger.plans.queries import QUERIES
    from starledger.session import session

    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    took = {}
    for name in [*sys.argv[1:]] or HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
