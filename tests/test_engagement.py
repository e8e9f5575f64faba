"""Engagement ratings: the hand-worked table and the defect choices."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from affinity import schemas
from affinity.operators import engagement as E


def _events(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENT)


def _ev(item, pairs):
    return [("s", "u", item, code, ts) for code, ts in pairs]


def test_hand_worked_table(spark):
    rows = (
        _ev("a", [(7, 1), (7, 2), (3, 3)])
        + _ev("b", [(3, 1), (-3, 2), (7, 4)])
        + _ev("c", [(3, 1), (-3, 2)])
        + _ev("d", [(5, t) for t in range(1, 8)])
        + _ev("e", [(6, 1), (6, 2), (7, 3), (7, 4), (7, 5), (7, 6)])
        + _ev("f", [(3, 1), (3, 9), (-3, 10)])
        + _ev("g", [(-1, 5)])
        + _ev("h", [(0, 1), (4, 2)])
    )
    got = {r.item: (r.rating, r.timestamp, r.event) for r in E.engagement_ratings(_events(spark, rows)).collect()}
    assert got == {
        "a": (60.0, 3, 3),
        "b": (5.0, 4, 7),
        "d": (47.0, 7, 5),
        "e": (21.0, 2, 6),   # tie at 21: lower code wins
        "f": (60.0, 9, 3),   # cancelling does not move the time
        "h": (40.0, 2, 4),
    }


def test_more_negatives_than_positives(spark):
    rows = _ev("x", [(3, 1), (-3, 2), (-3, 3), (7, 4)])
    got = E.engagement_ratings(_events(spark, rows)).collect()
    assert [(r.rating, r.event) for r in got] == [(5.0, 7)]


def test_beyond_list_end_saturates(spark):
    rows = _ev("x", [(7, t) for t in range(20)])
    assert E.engagement_ratings(_events(spark, rows)).first().rating == 24.0


def test_latest_cancelled_event_keeps_its_time(spark):
    rows = _ev("x", [(5, 1), (5, 8), (-5, 9)])
    r = E.engagement_ratings(_events(spark, rows)).first()
    assert (r.rating, r.timestamp) == (25.0, 8)


def test_unknown_event_fails_or_drops(spark):
    rows = _ev("x", [(9, 1)]) + _ev("y", [(7, 1)])
    with pytest.raises(PySparkException, match="unknown"):
        E.engagement_ratings(_events(spark, rows)).collect()
    kept = E.engagement_ratings(_events(spark, rows), on_unknown="drop").collect()
    assert [r.item for r in kept] == ["y"]


def test_unknown_event_cancelled_is_fine(spark):
    rows = _ev("x", [(9, 1), (-9, 2), (7, 3)])
    assert [r.event for r in E.engagement_ratings(_events(spark, rows)).collect()] == [7]


def test_custom_score_rows(spark):
    rows = _ev("x", [(1, 1), (2, 2)])
    got = E.engagement_ratings(_events(spark, rows), scores=[(1, "one", [10]), (2, "two", [20, 30])]).first()
    assert (got.rating, got.event) == (20.0, 2)


def test_support_and_net_shapes(spark):
    rows = _ev("x", [(3, 1), (3, 2), (-3, 3), (0, 4)])
    sup = E.event_support(_events(spark, rows)).collect()
    assert [(r.event, r.pos, r.neg, r.latest) for r in sup] == [(3, 2, 1, 2)]
    net = E.net_event_support(E.event_support(_events(spark, rows))).collect()
    assert [(r.event, r.net) for r in net] == [(3, 1)]
    pol = E.event_polarity(_events(spark, rows)).orderBy("timestamp").collect()
    assert [r.polarity for r in pol] == [1, 1, -1]


def test_explicit_passes_everything(spark):
    rows = [("s", "u", "i", -2, 1.5, 10), ("s", "u", "i", -2, 1.5, 10), ("s", "u", "j", 0, 3.0, 11)]
    out = E.engagement_ratings_explicit(spark.createDataFrame(rows, schemas.EVENT_RATING))
    assert out.columns == ["site", "user", "item", "rating", "timestamp", "event"]
    assert out.count() == 3


def test_one_rating_per_triple_on_driver_tables(spark):
    from affinity.catalog import ratings
    from tests.conftest import SF_SMALL

    r = ratings(spark, SF_SMALL)
    assert r.count() == r.select("site", "user", "item").distinct().count()
    assert r.where(F.col("rating") <= 0).count() == 0


def test_empty_input(spark):
    out = E.engagement_ratings(_events(spark, []))
    assert out.count() == 0
    assert [(f.name, f.dataType) for f in out.schema.fields] == [
        (f.name, f.dataType) for f in schemas.ENGAGEMENT_RATING.fields]
