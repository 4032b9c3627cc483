"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs end to end (derive structures from ``lineitem``, then the operators) and is
forced with the ``noop`` sink, so nothing is collected to the driver.  One warm-up query on
the smallest scale factor runs first (JVM start and code generation), untimed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["pipeline_rmsd", "entry_errors", "number_residues", "orient_sites", "frame_moments",
            "fit_corrections", "rmsd_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from orisite.plans.derived import QUERIES
    from orisite.session import Materializer, local_session

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8), app="orisite-bench")
    spark.conf.set("spark.orisite.spread", spark.sparkContext.defaultParallelism)  # the table is one row group
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        QUERIES["number_residues"](spark, warm).write.format("noop").mode("overwrite").save()
        Materializer.drop_all()
    times = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        Materializer.drop_all()  # the query has been consumed: its stage tables can go
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
