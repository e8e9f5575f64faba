"""Figures at sf0.01 from the survey's independent scratch runs (Spark and DuckDB)."""

from pyspark.sql import functions as F

from affinity.catalog import QUERIES, events
from affinity.operators import engagement as E
from tests.conftest import SF_CHECK


def _dist(df):
    return dict(sorted((r[0], r[1]) for r in df.groupBy("score").count().collect()))


def test_purchase_score_distributions(spark):
    one = QUERIES["purchase_preferences"](spark, SF_CHECK)
    assert _dist(one) == {0: 40, 1: 5683, 2: 25510, 3: 18363, 4: 6829, 5: 2966}
    five = QUERIES["build_purchase_preferences"](spark, SF_CHECK)
    assert _dist(five) == {1: 7573, 2: 26883, 3: 16628, 4: 326, 5: 8422}


def test_engagement_counts(spark):
    support = E.event_support(events(spark, SF_CHECK))
    assert support.select("site", "user", "item").distinct().count() == 2898
    ratings = E.engagement_ratings(events(spark, SF_CHECK))
    assert ratings.count() == 2727
    assert sorted(r[0] for r in ratings.select("event").distinct().collect()) == [1, 2, 3, 4, 5, 6, 7]
    only_negative = support.groupBy("site", "user", "item").agg(F.sum("pos").alias("p")).where("p = 0").count()
    assert only_negative == 117
    assert ratings.where("rating = 21").count() >= 4  # the four ties at 21 resolve to one rating each
