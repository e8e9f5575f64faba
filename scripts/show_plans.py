"""Print the final physical plans of the headline queries, as adaptive execution ran them.

    python scripts/show_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from affinity.catalog import QUERIES  # noqa: E402
from affinity.session import local_session  # noqa: E402

HEADLINE = ["purchase_preferences", "engagement_ratings", "user_index", "feature_matrix", "feature_rated_block"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or HEADLINE
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        print(f"==================== {name}")
        df = QUERIES[name](spark, sf)
        df.collect()  # small tables; the plan below is the one that ran
        print(df._jdf.queryExecution().executedPlan().toString())
    spark.stop()


if __name__ == "__main__":
    main()
