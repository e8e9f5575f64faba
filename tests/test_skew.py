"""One user or item with 90 % of 100,000 lines is spread over many tasks, with equal results."""

import pytest
from pyspark.sql import functions as F

from affinity.operators import features as FT
from affinity.operators import purchase as P
from affinity.plans.heavy import dealt_join, heavy_keys

ROWS = 100_000


def _shares(df, spark):
    """Largest share of the rows in one partition of ``df``, joins shuffled and partitions not merged."""
    rows = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in rows) / sum(r["count"] for r in rows)


@pytest.fixture()
def shuffled(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "200"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _support(spark, hot):
    other = F.when(F.col("id") % 10 == 0, F.col("id") % 997).otherwise(F.lit(-1))
    if hot == "user":
        return spark.range(ROWS).select(
            F.concat(F.lit("s"), F.col("id") % 2).alias("site"), other.cast("string").alias("user"),
            F.col("id").cast("int").alias("item"), F.lit(1).cast("long").alias("support"))
    return spark.range(ROWS).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("user"),
                                    other.cast("int").alias("item"), (F.col("id") % 5 + 1).cast("double").alias("pref"))


def _same(a, b, *cols):
    a.sparkSession.conf.set("spark.sql.shuffle.partitions", "8")  # results only; the shares were taken before
    return [df.agg(F.count(F.lit(1)), F.sum(F.hash(*cols))).first() for df in (a, b)]


def test_hot_user(shuffled):
    support = _support(shuffled, "user")
    totals = support.groupBy("site", "user").agg(F.count(F.lit(1)).alias("total"))
    heavy = heavy_keys(support, ["site", "user"])
    dealt = P.raw_preference(support, totals, heavy)
    assert _shares(dealt, shuffled) < 0.02
    assert heavy.count() < 1000  # (100 of the 997 other users hold a thousandth)
    assert len(set(_same(dealt, P.raw_preference(support, totals), "site", "user", "item", "pref"))) == 1


def test_hot_item(shuffled):
    prefs = _support(shuffled, "item")
    maxima = P.item_max_preference(prefs)
    dealt = P.scale_preferences(prefs, maxima, heavy_keys(prefs, ["item"]))
    assert _shares(dealt, shuffled) < 0.02
    assert len(set(_same(dealt, P.scale_preferences(prefs, maxima), "user", "item", "score"))) == 1


def test_whole_pipeline_with_a_hot_user_at_defaults(shuffled):
    lines = shuffled.range(ROWS).select(
        F.lit("s").alias("site"), F.when(F.col("id") % 10 == 0, F.col("id") % 9973).otherwise(-1).cast("string").alias("user"),
        (F.col("id") / 3).cast("long").cast("string").alias("group"), F.col("id").alias("timestamp"), (F.col("id") % 50_021).cast("int").alias("item"))
    got = P.purchase_preferences(lines)
    assert _shares(got, shuffled) < 0.02
    support, totals = P.item_support(lines), P.user_order_totals(lines)
    prefs = P.raw_preference(support, totals)
    assert len(set(_same(got, P.scale_preferences(prefs, P.item_max_preference(prefs)), "site", "user", "item", "score"))) == 1


def test_cold_keys_are_not_copied(shuffled):
    even = shuffled.range(20_000).select((F.col("id") % 5000).alias("k"), "id")
    assert heavy_keys(even, ["k"]) is None
    assert heavy_keys(even.where("false"), ["k"]) is None
    one = even.unionByName(shuffled.range(2000).select(F.lit(-1).alias("k"), "id"))
    [hot] = heavy_keys(one, ["k"]).collect()
    assert hot["_key"] == one.where("k = -1").select(F.xxhash64("k")).first()[0] and 85 <= hot["_parts"] <= 100
    small = one.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = dealt_join(one, small, ["k"], ["id"], heavy_keys(one, ["k"]))
    assert joined.columns == ["k", "id", "v"] and joined.count() == 22_000 and joined.where("v <> 2 * k").count() == 0


def test_hot_user_in_the_rated_sets(shuffled):
    ratings = shuffled.range(30_000).select(
        F.lit("s").alias("site"), F.when(F.col("id") % 10 == 0, F.col("id") % 97).otherwise(-1).cast("string").alias("user"),
        (F.col("id") % 500).cast("string").alias("item"), F.lit(1.0).alias("rating"), F.col("id").alias("timestamp"),
        F.lit(7).alias("event"))
    block = FT.prepare(ratings, partitions=8).rated_block()
    assert _shares(block, shuffled) < 0.02
    assert block.count() == 30_000
    weight = block.groupBy("user_row").agg(F.sum("value").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert abs(weight[0] - 1) < 1e-6 and abs(weight[1] - 1) < 1e-6
