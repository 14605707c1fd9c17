"""Headline-query timings.

Runs the main queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is fully
executed with the ``noop`` sink (no collect to the driver), after one
warm-up pass of the same queries on sf0.001.  ``label_similar``
is timed from scratch; the queries after it that read labelled notices reuse
its checkpointed result, as a caller would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docket.plans.catalog import QUERIES  # noqa: E402
from docket.session import build_session  # noqa: E402

HEADLINE = [
    "label_similar",
    "exact_copy_documents",
    "label_similar_documents",
    "label_similar_orders",
    "label_similar_hot",
    "first_match",
    "first_match_offline",
    "two_day_report",
    "tfidf_pair_cosine",
    "verdict_parse",
    "landing_accept",
    "assign_row_ids",
    "account_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, int(cpus) * 2)))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=parts)
    # Warm-up pass on the smallest data set: JVM JIT, generated-code cache and
    # Python workers, which a long-running service pays once.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir):
        for name in only:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
