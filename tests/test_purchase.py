"""Purchase preferences: hand-worked case, properties, explicit pass-through."""

from pyspark.sql import functions as F

from affinity import schemas
from affinity.operators import purchase as P


def _lines(spark, rows):
    return spark.createDataFrame(rows, schemas.ORDER_LINE)


def test_hand_worked(spark):
    # u1: order g1 {10, 20}, order g2 {10}; u2: order g3 {20}
    lines = _lines(spark, [
        ("s", "u1", "g1", 1, 10), ("s", "u1", "g1", 1, 20), ("s", "u1", "g2", 2, 10), ("s", "u2", "g3", 3, 20),
    ])
    got = sorted(tuple(r) for r in P.purchase_preferences(lines).collect())
    assert got == [("s", "u1", 10, 5), ("s", "u1", 20, 3), ("s", "u2", 20, 5)]


def test_duplicates_inside_an_order_count(spark):
    lines = _lines(spark, [("s", "u", "g", 1, 7), ("s", "u", "g", 1, 7), ("s", "u", "h", 2, 8)])
    support = {(r.item): r.support for r in P.item_support(lines).collect()}
    assert support == {7: 2, 8: 1}
    totals = P.user_order_totals(lines).collect()
    assert [(r.user, r.total) for r in totals] == [("u", 2)]


def test_item_maximum_spans_sites(spark):
    # Same item in two sites: the stronger preference elsewhere lowers this one.
    lines = _lines(spark, [
        ("a", "u", "g1", 1, 1), ("a", "u", "g2", 2, 2),      # item 1: ln(1.5)
        ("b", "v", "g3", 1, 1),                               # item 1: ln(2)
    ])
    got = {(r.site, r.item): r.score for r in P.purchase_preferences(lines).collect()}
    assert got[("b", 1)] == 5
    assert got[("a", 1)] == 3  # round(5 * ln 1.5 / ln 2) = round(2.92)


def test_half_up_rounding(spark):
    from affinity.functions.columns import half_up
    df = spark.createDataFrame([(2.5,), (3.5,), (2.4999,), (0.0,)], "x double")
    assert [r[0] for r in df.select(half_up(F.col("x")).cast("int")).collect()] == [3, 4, 2, 0]


def test_transactions_flat_and_ordered(spark):
    lines = _lines(spark, [
        ("s", "u", "b", 5, 1), ("s", "u", "b", 4, 2), ("s", "u", "a", 9, 3), ("s", "w", "c", 1, 4),
    ])
    got = sorted(tuple(r) for r in P.build_transactions(lines).collect())
    # order b starts at its earliest line (4) and comes before order a
    assert got == [("s", "u", 0, "b", 4, 1), ("s", "u", 0, "b", 4, 2), ("s", "u", 1, "a", 9, 3),
                   ("s", "w", 0, "c", 1, 4)]
    assert P.explode_transactions(P.build_transactions(lines)).count() == 4


def test_explicit_truncates_and_keeps_duplicates(spark):
    ratings = spark.createDataFrame([("s", "u", 1, 2.7, 0), ("s", "u", 1, 2.7, 1), ("s", "u", 2, -1.9, 2)],
                                    schemas.PURCHASE_RATING)
    got = sorted(tuple(r) for r in P.purchase_ratings_explicit(ratings).collect())
    assert got == [("s", "u", 1, 2), ("s", "u", 1, 2), ("s", "u", 2, -1)]


def test_properties_on_driver_tables(spark):
    from affinity.catalog import lines_by_priority
    from tests.conftest import SF_SMALL

    prefs = P.purchase_preferences(lines_by_priority(spark, SF_SMALL))
    stats = prefs.agg(F.min("score"), F.max("score")).first()
    assert 0 <= stats[0] and stats[1] == 5
    # every item has at least one 5
    no_five = prefs.groupBy("item").agg(F.max("score").alias("m")).where("m != 5").count()
    assert no_five == 0


def test_empty_input(spark):
    lines = _lines(spark, [])
    out = P.purchase_preferences(lines)
    assert out.count() == 0
    assert [(f.name, f.dataType) for f in out.schema.fields] == [
        (f.name, f.dataType) for f in schemas.PURCHASE_PREFERENCE.fields]
