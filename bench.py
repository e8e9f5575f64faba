"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=5 python bench.py

Each workload is built and forced with the ``noop`` writer (full computation,
no output); one warm-up run, then the median of ``BENCH_RUNS`` timed runs.
Workloads that build indexes include their checkpoint jobs in the time.
``purchase_preferences_skewed`` runs the flagship on lines of which one user
holds nine in ten; it is reported beside the headline workloads and is not part
of the total, which stays comparable between rounds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from affinity.catalog import QUERIES, lines_one_shop, ratings  # noqa: E402
from affinity.operators import features as FT  # noqa: E402
from affinity.operators.purchase import purchase_preferences  # noqa: E402
from affinity.session import local_session  # noqa: E402


def _force(df):
    df.write.format("noop").mode("overwrite").save()


def _index_tables(spark, sf):
    users, items = FT.index_tables(ratings(spark, sf))
    _force(users)
    _force(items)


def _feature_matrix(spark, sf):
    ff = FT.prepare(ratings(spark, sf))
    _force(ff.matrix())
    _force(ff.rated_block())


def _skewed(spark, sf):
    lines = lines_one_shop(spark, sf)
    hot = F.when(F.pmod(F.xxhash64("group", "item"), F.lit(10)) < 9, F.lit("hot")).otherwise(F.col("user"))
    _force(purchase_preferences(lines.withColumn("user", hot)))


WORKLOADS = {
    "purchase_preferences": lambda s, sf: _force(QUERIES["purchase_preferences"](s, sf)),
    "build_purchase_preferences": lambda s, sf: _force(QUERIES["build_purchase_preferences"](s, sf)),
    "engagement_ratings": lambda s, sf: _force(QUERIES["engagement_ratings"](s, sf)),
    "user_item_index": _index_tables,
    "feature_matrix": _feature_matrix,
}
BESIDE = {"purchase_preferences_skewed": _skewed}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="affinity-bench")
    spark.sparkContext.setLogLevel("ERROR")
    medians = {}
    for name, run in (WORKLOADS | BESIDE).items():
        run(spark, sf_dir)  # warm-up
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(spark, sf_dir)
            times.append(time.perf_counter() - t0)
        medians[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(medians[name] for name in WORKLOADS), 3), "unit": "sec",
                      "queries": medians, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
