"""Web-shop order-item log.

The log has one row per ordered item: site id, visitor id, server time, order
id, SKU action id, price, quantity and a deleted flag.  A read covers one site
and an open time interval (both ends excluded).  Expressed as a filter and a
projection, so Spark pushes both into the scan (Parquet) or the query (JDBC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.sources.fieldspec import FieldSpec
from affinity.sources.readers import jdbc_options, map_orders

# Columns of the order-item log, in order.
LOG_ITEM_FIELDS = ["idsite", "idvisitor", "server_time", "idorder", "idaction_sku", "price", "quantity", "deleted"]

# How log columns map onto purchase-line fields; the SKU action id identifies
# the item (two lines with one SKU share it).
LOG_LINE_SPEC = FieldSpec.of({
    "site": "idsite", "user": "idvisitor", "timestamp": "server_time", "group": "idorder", "item": "idaction_sku",
})


def order_item_log(log: DataFrame, site, start, end, drop_deleted: bool = False) -> DataFrame:
    """Rows of ``site`` with ``start < server_time < end``; deleted lines kept
    unless ``drop_deleted``."""
    cond = (F.col("idsite") == F.lit(site)) & (F.col("server_time") > F.lit(start)) & (F.col("server_time") < F.lit(end))
    if drop_deleted:
        cond = cond & ~F.coalesce(F.col("deleted").cast("boolean"), F.lit(False))
    return log.where(cond).select(*LOG_ITEM_FIELDS)


def log_options(url: str, table: str, start, end, partitions: int, properties: dict | None = None) -> dict[str, str]:
    """JDBC options of a log read: its time interval is cut into ``partitions`` strides of the server time."""
    return jdbc_options(url, table, properties, "server_time", start, end, partitions)


def read_order_item_log(spark, url: str, table: str, site, start, end, properties: dict | None = None,
                        drop_deleted: bool = False, partitions: int = 16) -> DataFrame:
    """The log table over JDBC, read in strides of the server time; the filter reaches the database as a WHERE clause."""
    log = spark.read.format("jdbc").options(**log_options(url, table, start, end, partitions, properties)).load()
    return order_item_log(log, site, start, end, drop_deleted)


def read_log_lines(spark, url: str, table: str, site, start, end, **options) -> DataFrame:
    """The log as purchase lines, ready for the purchase preferences."""
    return map_orders(read_order_item_log(spark, url, table, site, start, end, **options), LOG_LINE_SPEC)
