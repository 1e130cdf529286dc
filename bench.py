"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from partwise.plans import load_all  # noqa: E402
from partwise.session import local_session  # noqa: E402

HEADLINE = [
    "p05_drop_duplicates", "d05_value_distribution", "e01_parameter_families", "e05_grade_hits", "j04_threshold_topn", "j07_similar_search",
    # The first duplicate query runs the whole analysis (pairs, groups, scores); the others reuse it, so only it is timed.
    "j12_pair_similarity", "c05_rule_classifier", "c07_material_classifier", "c26_rule_vote", "q06_total_grade_issues",
    "y07_batch_triage", "n01_stratified_split", "t01_token_frequency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = load_all(), {}
    for name in HEADLINE:
        start = time.time()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
