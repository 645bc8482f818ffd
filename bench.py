"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from typeharvest.plans import catalog  # noqa: E402
from typeharvest.session import local_session  # noqa: E402

HEADLINE = [
    "ex1_pattern_counts_documents", "ex1_constraint_counts", "o1_package_ranking", "a4_rollup_file_package_corpus",
    "p1_p9_predicates", "p1_p9_predicates_row_local", "a6_summary_per_package", "f2_interesting",
    "tv4_tv6_p10_declarations", "ex6_ex12_extract_annotations", "a13_o5_sorted_distinct_lines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        t = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
