"""Readers, field mapping, score table, order-item log."""

import json
import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from affinity.sources import readers as R
from affinity.sources.fieldspec import FieldSpec, apply_field_spec, default_spec
from affinity.sources.orderlog import LOG_ITEM_FIELDS, LOG_LINE_SPEC, order_item_log
from affinity.sources.scores import DEFAULT_EVENT_SCORES, default_scores, load_scores
from affinity import schemas


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_events_text(spark, scratch):
    p = _write(os.path.join(scratch, "ev.txt"), "s1,u1,i1,1000,7\ns1,u1,i2,2000,-3,\n")
    rows = [tuple(r) for r in R.read_events_text(spark, p).collect()]
    assert rows == [("s1", "u1", "i1", 7, 1000), ("s1", "u1", "i2", -3, 2000)]
    px = _write(os.path.join(scratch, "evx.txt"), "s1,u1,i1,1000,7,2.5\n")
    assert [tuple(r) for r in R.read_events_text(spark, px, explicit=True).collect()] == [
        ("s1", "u1", "i1", 7, 2.5, 1000)]


def test_text_wrong_arity_fails(spark, scratch):
    p = _write(os.path.join(scratch, "bad.txt"), "s1,u1,i1,1000\n")
    with pytest.raises(PySparkException, match="expected 5 fields"):
        R.read_events_text(spark, p).collect()


def test_text_bad_number_fails(spark, scratch):
    p = _write(os.path.join(scratch, "bad2.txt"), "s1,u1,i1,soon,7\n")
    with pytest.raises(PySparkException, match="invalid value"):
        R.read_events_text(spark, p).collect()


def test_orders_text(spark, scratch):
    p = _write(os.path.join(scratch, "o.txt"), "s,10,u,g1,42\n")
    assert [tuple(r) for r in R.read_orders_text(spark, p).collect()] == [("s", "u", "g1", 10, 42)]
    px = _write(os.path.join(scratch, "ox.txt"), "s,10,u,42,3.5\n")
    assert [tuple(r) for r in R.read_orders_text(spark, px, explicit=True).collect()] == [("s", "u", 42, 3.5, 10)]


def test_documents(spark, scratch):
    docs = [{"site": "s", "user": "u", "item": "i", "timestamp": "5", "event": "3", "extra": "x"}]
    p = _write(os.path.join(scratch, "d.json"), "\n".join(json.dumps(d) for d in docs))
    assert [tuple(r) for r in R.read_events_documents(spark, p).collect()] == [("s", "u", "i", 3, 5)]
    odocs = [{"site": "s", "user": "u", "order": "g", "timestamp": "5", "item": "12"}]
    po = _write(os.path.join(scratch, "o.json"), "\n".join(json.dumps(d) for d in odocs))
    assert [tuple(r) for r in R.read_orders_documents(spark, po).collect()] == [("s", "u", "g", 5, 12)]


def test_documents_missing_field_fails(spark, scratch):
    p = _write(os.path.join(scratch, "d.json"), json.dumps({"site": "s", "user": "u", "item": "i", "event": "3"}))
    with pytest.raises(PySparkException, match="missing"):
        R.read_events_documents(spark, p).collect()


def test_parquet_with_spec_and_timestamp(spark, scratch):
    df = spark.createDataFrame([("a", 7, "x", 3, datetime(1970, 1, 2))],
                               "shop string, who long, sku string, code int, at timestamp_ntz")
    p = os.path.join(scratch, "ev.parquet")
    df.write.parquet(p)
    spec = FieldSpec.of({"site": "shop", "user": "who", "item": "sku", "event": "code", "timestamp": "at"})
    got = R.read_events_parquet(spark, p, spec).first()
    assert tuple(got) == ("a", "7", "x", 3, 86_400_000)


def test_field_spec_xml_and_defaults():
    xml = ('<fieldspec><field name="site" type="String">site</field>'
           '<field name="group" type="String">order</field></fieldspec>')
    spec = FieldSpec.from_xml(xml)
    assert spec.source("group") == "order"
    assert default_spec("NPREF", False).source("group") == "order"
    assert default_spec("EPREF", True).source("score") == "score"
    with pytest.raises(ValueError):
        FieldSpec.from_xml("<fieldspec/>")
    with pytest.raises(KeyError):
        spec.source("item")


def test_field_spec_expression(spark):
    df = spark.createDataFrame([(5, 1)], "n long, m long")
    spec = FieldSpec.of({"site": "'x'", "user": "n + m", "group": "n", "timestamp": "m", "item": "n * 2"})
    assert tuple(apply_field_spec(df, spec, schemas.ORDER_LINE).first()) == ("x", "6", "5", 1, 10)


def test_scores_xml_roundtrip(spark, scratch):
    body = "".join(f"<EventScore><type>{e}</type><description>{d}</description>"
                   f"<scores>{','.join(map(str, s))}</scores></EventScore>" for e, d, s in DEFAULT_EVENT_SCORES)
    p = _write(os.path.join(scratch, "scores.xml"), f"<EventScores>{body}</EventScores>")
    loaded = sorted(tuple(r) for r in load_scores(spark, p).collect())
    assert loaded == sorted((e, d, s) for e, d, s in DEFAULT_EVENT_SCORES)
    assert default_scores(spark).count() == 11


def test_dispatch(spark, scratch):
    p = _write(os.path.join(scratch, "ev.txt"), "s1,u1,i1,1000,7\n")
    assert R.read_source(spark, "EPREF", "file", False, path=p).count() == 1
    with pytest.raises(ValueError):
        R.read_source(spark, "EPREF", "REDIS", False, path=p)
    with pytest.raises(ValueError):
        R.read_source(spark, "XPREF", "FILE", False, path=p)


def test_order_item_log_open_interval(spark):
    rows = [(1, "v", datetime(2020, 1, d), "o", 9, 1.0, 1.0, d == 3) for d in (1, 2, 3, 4)]
    log = spark.createDataFrame(rows, "idsite int, idvisitor string, server_time timestamp_ntz, idorder string, "
                                      "idaction_sku long, price double, quantity double, deleted boolean")
    lo, hi = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ'2020-01-04 00:00:00'")
    got = order_item_log(log, 1, lo, hi)
    assert got.columns == LOG_ITEM_FIELDS
    assert sorted(r.server_time.day for r in got.collect()) == [2, 3]
    assert [r.server_time.day for r in order_item_log(log, 1, lo, hi, drop_deleted=True).collect()] == [2]
    assert order_item_log(log, 2, lo, hi).count() == 0
    lines = R.map_orders(got, LOG_LINE_SPEC)
    assert lines.columns == ["site", "user", "group", "timestamp", "item"]


def test_order_item_log_pushdown(spark):
    from affinity.catalog import _q_order_item_log
    from tests.conftest import SF_SMALL

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = _q_order_item_log(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(o_orderpriority), IsNotNull(o_orderdate), EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "GreaterThan(o_orderdate," in plan and "LessThan(o_orderdate," in plan


def test_order_documents_explicit(spark, scratch):
    docs = [{"site": "s", "user": "u", "item": "12", "timestamp": "5", "score": "4.5"}]
    p = _write(os.path.join(scratch, "ox.json"), "\n".join(json.dumps(d) for d in docs))
    assert [tuple(r) for r in R.read_orders_documents(spark, p, explicit=True).collect()] == [("s", "u", 12, 4.5, 5)]
    df = spark.createDataFrame([("s", "u", "i", "7", "3", "1.5")], "site string, user string, item string, "
                                                                   "timestamp string, event string, score string")
    got = R.read_events_documents(spark, df, explicit=True).first()
    assert tuple(got) == ("s", "u", "i", 3, 1.5, 7)


def test_documents_as_map_column(spark):
    df = spark.createDataFrame([({"site": "s", "user": "u", "item": "i", "timestamp": "9", "event": "7", "x": "1"},)],
                               "doc map<string,string>")
    assert tuple(R.read_events_documents(spark, df, map_column="doc").first()) == ("s", "u", "i", 7, 9)
    missing = spark.createDataFrame([({"site": "s", "user": "u", "item": "i", "event": "7"},)], "doc map<string,string>")
    with pytest.raises(PySparkException, match="missing"):
        R.read_events_documents(spark, missing, map_column="doc").collect()


def test_reader_schemas(spark, scratch):
    from affinity.catalog import events, events_explicit, lines_one_shop
    from tests.conftest import SF_SMALL

    def typed(df):
        return [(f.name, f.dataType) for f in df.schema.fields]

    assert typed(events(spark, SF_SMALL)) == typed(spark.createDataFrame([], schemas.EVENT))
    assert typed(events_explicit(spark, SF_SMALL)) == typed(spark.createDataFrame([], schemas.EVENT_RATING))
    assert typed(lines_one_shop(spark, SF_SMALL)) == typed(spark.createDataFrame([], schemas.ORDER_LINE))
