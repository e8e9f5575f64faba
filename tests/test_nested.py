"""Nested documents: paths, arrays, and what a missing value does."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from affinity.sources.fieldspec import FieldSpec
from affinity.sources.readers import read_events_documents, read_orders_documents, read_source

EVENTS = FieldSpec.of({"site": "$.shop.id", "user": "$['user.name']", "item": "$.items[0].sku", "event": "$.code", "timestamp": "$.at"})
LINES = FieldSpec.of({"site": "$.shop", "user": "$.by", "group": "$.no", "timestamp": "$.at", "item": "@.sku"})


def _event(**changes):
    return {"shop": {"id": "s1", "more": {"deep": [1, 2]}}, "user.name": "ann", "items": [{"sku": 12}, {"sku": 13}], "code": "6", "at": 1000, **changes}


def _docs(spark, docs):
    return spark.createDataFrame([(json.dumps(d) if d is not None else None,) for d in docs], "doc string")


def _order(no, lines, **changes):
    return {"shop": "s1", "by": "ann", "no": no, "at": 1000, "lines": lines, **changes}


@pytest.mark.parametrize("parsed", [True, False])
def test_events_by_paths(spark, parsed):
    docs = _docs(spark, [_event(), _event(code=-3, at="2000")])
    docs = docs.select(F.parse_json("doc").alias("doc")) if parsed else docs
    got = read_events_documents(spark, docs, EVENTS, variant_column="doc")
    assert sorted(r.asDict().items() for r in got.collect()) == sorted(
        {"site": "s1", "user": "ann", "item": "12", "event": e, "timestamp": t}.items() for e, t in ((6, 1000), (-3, 2000)))


def test_json_files_by_paths(spark, scratch):
    path = f"{scratch}/events"
    _docs(spark, [_event(), _event(code=2)]).repartition(2).write.text(path)
    got = read_source(spark, "EPREF", "ELASTIC", False, source=path, spec=EVENTS)
    assert sorted(r.event for r in got.collect()) == [2, 6]


def test_lines_of_orders(spark):
    """One row per element, repeated ones too; an order without lines has none."""
    docs = [_order("a", [{"sku": 1}, {"sku": 1}, {"sku": 2, "other": [0]}]), _order("b", []), _order("c", None), _order("d", [{"sku": "3"}])]
    del docs[2]["lines"]
    got = read_orders_documents(spark, _docs(spark, [*docs, None]), LINES, variant_column="doc", each="$.lines")
    assert sorted((r.group, r.item) for r in got.collect()) == [("a", 1), ("a", 1), ("a", 2), ("d", 3)]


def test_long_order(spark):
    docs = _docs(spark, [_order("a", [{"sku": k} for k in range(20_000)])])
    got = read_orders_documents(spark, docs, LINES, variant_column="doc", each="$.lines")
    assert got.select("item").distinct().count() == got.count() == 20_000


@pytest.mark.parametrize("bad", [_event(shop={}), _event(items=[]), _event(at=None), _event(code="six"), None])
def test_missing_and_malformed_values_fail(spark, bad):
    with pytest.raises(PySparkException, match="field '"):
        read_events_documents(spark, _docs(spark, [_event(), bad]), EVENTS, variant_column="doc").collect()


def test_an_element_without_its_field_fails(spark):
    with pytest.raises(PySparkException, match="field 'item'"):
        read_orders_documents(spark, _docs(spark, [_order("a", [{"sku": 1}, {}])]), LINES, variant_column="doc", each="$.lines").collect()


def test_malformed_json_fails(spark, scratch):
    path = f"{scratch}/bad"
    spark.createDataFrame([('{"shop": {"id": "s1"',)], "doc string").write.text(path)
    with pytest.raises(Exception, match="MALFORMED|Malformed"):  # (not always wrapped by PySpark)
        read_events_documents(spark, path, EVENTS).collect()


def test_what_a_spec_needs(spark):
    docs = _docs(spark, [_event()])
    with pytest.raises(ValueError, match="each="):
        read_orders_documents(spark, docs, LINES, variant_column="doc")
    with pytest.raises(ValueError, match="variant_column="):
        read_events_documents(spark, docs, EVENTS)
    with pytest.raises(ValueError, match="shop"):
        read_events_documents(spark, docs, EVENTS.with_fields(site=("shop", "")), variant_column="doc")


def test_clashing_columns_and_no_documents(spark):
    docs = _docs(spark, [_event()]).withColumns({"_doc": F.lit(1), "site": F.lit("other"), "$.code": F.lit("9")})
    assert [(r.site, r.event) for r in read_events_documents(spark, docs, EVENTS, variant_column="doc").collect()] == [("s1", 6)]
    assert read_events_documents(spark, docs.where("false"), EVENTS, variant_column="doc").collect() == []
    assert read_orders_documents(spark, docs.where("false"), LINES, variant_column="doc", each="$.lines").collect() == []
