"""Registered field specs, indexes that keep their numbers, nested transactions."""

import os
from datetime import datetime

import pytest

from affinity import schemas
from affinity.operators import features as FT
from affinity.operators import purchase as P
from affinity.sources.fieldspec import FieldSpec, default_spec
from affinity.sources.registry import find_spec, register_spec, registered_spec

OLD, NEW = FieldSpec.of({"site": "a", "user": "b"}), FieldSpec.of({"site": "c", "user": ("d", "String"), "item": "e"})


def test_versions_hold_from_their_time(spark, scratch):
    path = os.path.join(scratch, "specs")
    assert registered_spec(spark, path, "k", datetime(2024, 1, 1)) is None
    assert register_spec(spark, path, "k", OLD, datetime(2020, 1, 1)) == 1
    assert register_spec(spark, path, "k", NEW, datetime(2022, 1, 1)) == 2
    register_spec(spark, path, "other", OLD, datetime(2019, 1, 1))
    assert registered_spec(spark, path, "k", datetime(2019, 6, 1)) is None
    for at, spec in ((datetime(2020, 1, 1), OLD), (datetime(2021, 12, 31), OLD), (datetime(2022, 1, 1), NEW), (datetime(2030, 1, 1), NEW)):
        assert dict(registered_spec(spark, path, "k", at).fields) == dict(spec.fields)
    with pytest.raises(ValueError, match="already valid"):
        register_spec(spark, path, "k", OLD, datetime(2021, 1, 1))
    with pytest.raises(ValueError, match="no fields"):
        register_spec(spark, path, "k", FieldSpec({}), datetime(2023, 1, 1))
    # corrected on the same day: the later version counts
    assert register_spec(spark, path, "k", OLD, datetime(2022, 1, 1)) == 3
    assert dict(registered_spec(spark, path, "k", datetime(2022, 1, 1)).fields) == dict(OLD.fields)


def test_registered_first_else_xml_else_bundled(spark, scratch):
    path, xml = os.path.join(scratch, "specs"), os.path.join(scratch, "spec.xml")
    with open(xml, "w", encoding="utf-8") as fh:
        fh.write('<fieldspec><field name="site" type="String">shop_id</field></fieldspec>')
    register_spec(spark, path, "k", OLD, datetime(2020, 1, 1))
    assert find_spec(spark, "NPREF", False, key="k", registry=path, xml=xml).source("site") == "a"
    assert find_spec(spark, "NPREF", False, key="k", registry=path, at=datetime(2019, 1, 1), xml=xml).source("site") == "shop_id"
    assert find_spec(spark, "NPREF", False, key="unknown", registry=path, xml=xml).source("site") == "shop_id"
    assert dict(find_spec(spark, "EPREF", True).fields) == dict(default_spec("EPREF", True).fields)


def _ratings(spark, rows):
    return spark.createDataFrame([("s", u, i, 1.0, t, 7) for t, (u, i) in enumerate(rows)],
                                 "site string, user string, item string, rating double, timestamp long, event int")


def test_indexes_keep_their_numbers(spark):
    first = _ratings(spark, [("m", "i5"), ("b", "i1"), ("x", "i5")])
    second = _ratings(spark, [("a", "i0"), ("m", "i9"), ("z", "i5"), ("a", "i2")])
    users, items = FT.user_index(first), FT.item_index(first)
    more_users, more_items = FT.user_index(second, known=users), FT.item_index(second, known=items)
    assert {r.user: r.row for r in more_users.collect()} == {"b": 0, "m": 1, "x": 2, "a": 3, "z": 4}
    assert {r.item: r.col for r in more_items.collect()} == {"i1": 0, "i5": 1, "i0": 2, "i2": 3, "i9": 4}
    assert sorted(map(tuple, FT.user_index(first, known=more_users).collect())) == sorted(map(tuple, more_users.collect()))
    assert FT.user_index(first.where("false"), known=users).count() == 3
    assert sorted(r.row for r in FT.user_index(first, known=users.where("false")).collect()) == [0, 1, 2]
    # a matrix of the second batch on the extended indexes
    frame = FT.prepare(second, more_users, more_items)
    labels = {(r.urow, r.icol) for r in frame.rating_rows().collect()}
    assert labels == {(3, 2), (1, 4), (4, 1), (3, 3)}


def test_nested_transactions_are_bounded(spark):
    rows = [("s", "hot", f"g{k // 7:03d}", 1000 + k // 7, k % 50) for k in range(700)] + [("s", "u", "b", 5, 1), ("s", "u", "a", 9, 3), ("s", "u", "b", 4, 2)]
    lines = spark.createDataFrame(rows, schemas.ORDER_LINE)
    nested = P.nested_transactions(lines, items_per_row=20)
    got = nested.collect()
    hot = sorted((r for r in got if r.user == "hot"), key=lambda r: r.chunk)
    assert [r.chunk for r in hot] == list(range(35)) and all(sum(len(o["items"]) for o in r.orders) == 20 for r in hot)
    [small] = [r for r in got if r.user == "u"]
    assert [(o.seq, o.timestamp, o["items"]) for o in small.orders] == [(0, 4, [1, 2]), (1, 9, [3])]
    flat = P.unnest_transactions(nested)
    key = ["site", "user", "seq", "timestamp", "item"]
    assert sorted(map(tuple, flat.select(key).collect())) == sorted(map(tuple, P.build_transactions(lines).select(key).collect()))
    assert P.nested_transactions(lines.where("false")).count() == 0
