"""Benchmark of the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line. Each query is executed in
full through the ``noop`` sink (every column computed, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import catalog, closed_forms  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "credit_panel",     # entry A end to end: ratios, links, event windows, labels, winsorizing
    "event_window",     # bucketed range joins + labels
    "link_resolve",     # validity-interval linking
    "asof_loan",        # as-of match of loans to firm-years
    "capital_table",    # entry C: capital per model
    "eco_loss",         # economic loss per model
    "describe",         # exact quartiles via sketch brackets
    "corr_pairs",       # 171 correlations in one pass
    "knn_impute",       # exact neighbour search
    "strat_split",      # exact stratified split
    "smote",            # minority neighbours and synthetic rows
    "stump_cv",         # five distributed model fits and their metrics
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": "16g"})
    queries = {**catalog.QUERIES, **closed_forms.QUERIES}
    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in HEADLINE:
        for kept in (times, warm):  # the second run finds compiled code, nothing else
            t0 = time.time()
            queries[name](spark, sf).write.mode("overwrite").format("noop").save()
            kept[name] = round(time.time() - t0, 3)
            spark.catalog.clearCache()
        print(f"{name}: {times[name]}s, warm {warm[name]}s", file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "warm": warm, "sf": os.path.basename(sf.rstrip("/")),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
