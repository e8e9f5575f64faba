"""One user holding every row: does the sequence pass split it, and stay exact?  (Joins: tests/test_skew.py.)

    python scripts/skew_check.py [sf_dir] [partitions]

All order lines of the given tables are assigned to a single user (time = order
date, item = part).  The script prints how the user's rows spread over the range
partitions and compares positions, ranks and previous items with a plain
window over the whole group (which puts the user in one task, and is used here
only as the reference).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from affinity.catalog import lines_one_shop  # noqa: E402
from affinity.plans.materialize import materialize  # noqa: E402
from affinity.plans.sequence import _ranged, sequence  # noqa: E402
from affinity.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    partitions = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    spark = local_session(8, shuffle_partitions=partitions)
    spark.sparkContext.setLogLevel("ERROR")
    hot = (lines_one_shop(spark, sf).select(F.lit("hot").alias("user"), "timestamp", "item")
           .withColumn("rid", F.monotonically_increasing_id()))
    hot = materialize(hot)
    keys = ["user", "timestamp", "item"]
    spread = (_ranged(hot, keys, partitions, "rid").groupBy(F.spark_partition_id().alias("p")).count()
              .agg(F.count("*").alias("partitions"), F.max("count").alias("largest"), F.sum("count").alias("rows"))
              .first())
    print(f"rows {spread.rows}, partitions holding the hot user {spread.partitions} of {partitions}, "
          f"largest partition {spread.largest} ({spread.largest / spread.rows:.1%})")
    out = sequence(hot, keys, index="idx", group_cols=["user"], run_cols=["timestamp", "item"],
                   lag={"prev": "item"}, group_offset="pos", partitions=partitions, tie="rid")
    w = Window.partitionBy("user").orderBy("timestamp", "item", "rid")
    runs = (hot.select("user", "timestamp", "item").distinct()
            .select("*", F.lag("item").over(Window.partitionBy("user").orderBy("timestamp", "item")).alias("ref_prev")))
    ref = (hot.select("*", (F.row_number().over(w) - 1).alias("ref_idx"))
           .join(runs, ["user", "timestamp", "item"]))
    bad = (out.join(ref, ["user", "timestamp", "item", "rid"])
           .where("idx != ref_idx OR pos != ref_idx OR NOT (prev <=> ref_prev)").count())
    print(f"rows differing from the single-window reference: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
