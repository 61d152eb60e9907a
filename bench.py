"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

from lociflow.plans import catalogue  # noqa: E402
from lociflow.session import local_session  # noqa: E402

HEADLINE = ("compress_variants", "edges_symmetric", "neighbours_quality", "clusters_include", "msa_aligned", "contingency", "dense_calendar", "bh_fdr", "telemetry_lag", "telemetry_throttle")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session("bench", cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/customer.parquet").count()  # start the engine
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
