"""Mapping of the TPC-H-like tables onto purchase lines and engagement events.

Used by the registered queries, the benchmark and tests.

Purchases: ``lineitem`` joined to ``orders`` on the order key; user = customer,
group = order, time = order date, item = part; site is a constant (one shop) or
the order priority (five shops).

Engagement: ``events``; site = ``'site' || user_id % 3``, user = user id, item =
``'i' || k % 20`` with ``k`` from the JSON ``props``, time = ``ts``, and an
event code derived from the event type (and the event id, to reach all codes).
Explicit engagement uses ``value`` as the given score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.sources.fieldspec import FieldSpec
from affinity.sources.orderlog import LOG_ITEM_FIELDS

ONE_SHOP = "'shop'"

EVENT_CODE = (
    "CASE event_type"
    " WHEN 'view' THEN 7"
    " WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 5 ELSE 6 END"
    " WHEN 'signup' THEN CASE event_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 7 END"
    " WHEN 'purchase' THEN CASE WHEN event_id % 16 = 0 THEN 1 ELSE 6 END"
    " WHEN 'error' THEN -(1 + event_id % 7) END"
)

EVENT_SPEC = FieldSpec.of({
    "site": "concat('site', CAST(user_id % 3 AS STRING))",
    "user": "CAST(user_id AS STRING)",
    "item": "concat('i', CAST(from_json(props, 'k INT').k % 20 AS STRING))",
    "timestamp": "ts",
    "event": EVENT_CODE,
})
EVENT_SPEC_EXPLICIT = EVENT_SPEC.with_fields(score=("value", "Double"))


def order_spec(site: str = ONE_SHOP) -> FieldSpec:
    return FieldSpec.of({
        "site": site, "user": "o_custkey", "group": "o_orderkey", "timestamp": "o_orderdate", "item": "l_partkey",
    })


ORDER_SPEC_EXPLICIT = FieldSpec.of({
    "site": ONE_SHOP, "user": "o_custkey", "item": "l_partkey",
    "score": "l_extendedprice / 1000", "timestamp": "o_orderdate",
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order columns (the raw record of a purchase line)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                                                    "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def order_item_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines shaped as a web-shop order-item log."""
    src = order_lines_source(spark, sf_dir)
    return src.select(
        F.col("o_orderpriority").alias("idsite"), F.col("o_custkey").alias("idvisitor"),
        F.col("o_orderdate").alias("server_time"), F.col("o_orderkey").alias("idorder"),
        F.col("l_partkey").alias("idaction_sku"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"), (F.col("l_returnflag") == "R").alias("deleted"),
    ).select(*LOG_ITEM_FIELDS)
