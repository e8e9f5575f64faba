"""Purchase preferences.

For user ``u`` with ``t`` orders, an item bought ``s`` times (counting repeats
inside one order) has raw preference ``ln(1 + s/t)``.  Each raw preference is
divided by the largest raw preference of that item over all users and sites,
times 5, rounded half up: an integer 0..5 where the item's keenest buyer gets 5.

Plan shape: the input is read once, into a stored table of line counts per (site,
user, order, item), whose first aggregate combines before its shuffle.  Support
per user and item, orders per user, and the keys that hold a large share of the
lines (sketched while the table is written) come from it.  Support joins the totals on the user, and the
preferences join their maxima on the item; users and items with a large share are dealt over
parts in proportion to their lines (``plans.heavy``), all others join plainly.
The parts cannot change a result.  No build side is forced: small sides are
broadcast by measured size, large ones are merged and can spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions.columns import half_up
from affinity.plans.heavy import SHARE, dealt_join, key_sketch, listed
from affinity.plans.materialize import written
from affinity.plans.sequence import group_position

__all__ = [
    "build_transactions",
    "nested_transactions",
    "unnest_transactions",
    "user_order_totals",
    "explode_transactions",
    "item_support",
    "line_counts",
    "raw_preference",
    "item_max_preference",
    "scale_preferences",
    "purchase_preferences",
    "purchase_ratings_explicit",
]

_USER = ["site", "user"]

def build_transactions(lines: DataFrame) -> DataFrame:
    """Order lines grouped into time-ordered orders per user (N1), kept flat.

    One row per line: ``site, user, seq, group, timestamp, item`` where
    ``timestamp`` is the order time (earliest line time of the order) and
    ``seq`` the 0-based position of the order among the user's orders by
    (time, order id).  A nested one-row-per-user form would put a user's whole
    history in one row; the flat form keeps every order independent.
    """
    orders = lines.groupBy(*_USER, "group").agg(F.min("timestamp").alias("timestamp"))
    ranked = group_position(orders, group_cols=_USER, order_cols=["timestamp", "group"], name="seq")
    return (lines.drop("timestamp")
            .join(ranked, [*_USER, "group"])
            .select(*_USER, "seq", "group", "timestamp", "item"))


def nested_transactions(lines: DataFrame, items_per_row: int = 4096) -> DataFrame:
    """Transaction sequences per user in chunks of bounded size (N1, nested).

    ``site, user, chunk, orders array<struct<seq, timestamp, items>>``: a user's
    lines in order of (order position, item) are cut every ``items_per_row``
    items, so no row and no group grows with a user's history; an order at
    a cut continues in the next chunk with the same ``seq``.
    """
    placed = group_position(build_transactions(lines), group_cols=_USER, order_cols=["seq", "item"], name="_place")
    chunked = placed.withColumn("chunk", F.floor(F.col("_place") / F.lit(items_per_row)).cast("long"))
    orders = chunked.groupBy(*_USER, "chunk", "seq").agg(
        F.min("timestamp").alias("timestamp"), F.sort_array(F.collect_list("item")).alias("items"))
    return orders.groupBy(*_USER, "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "timestamp", "items"))).alias("orders"))


def unnest_transactions(nested: DataFrame) -> DataFrame:
    """One row per line of ``nested_transactions``: ``site, user, chunk, seq, timestamp, item``."""
    return (nested.select(*_USER, "chunk", F.explode("orders").alias("_o"))
            .select(*_USER, "chunk", "_o.seq", "_o.timestamp", F.explode("_o.items").alias("item")))


def user_order_totals(lines: DataFrame) -> DataFrame:
    """Number of distinct orders per user (N2): ``site, user, total``."""
    return lines.groupBy(*_USER).agg(F.count_distinct("group").alias("total"))


def explode_transactions(lines: DataFrame) -> DataFrame:
    """All items of a user's orders as one multiset (N3): ``site, user, item``.

    A projection of the order lines (or of flat transactions, which hold the
    same lines); duplicates are kept and no order needs to be built.
    """
    return lines.select(*_USER, "item")


def item_support(lines: DataFrame) -> DataFrame:
    """How often each user bought each item (N4): ``site, user, item, support``."""
    return lines.groupBy(*_USER, "item").agg(F.count(F.lit(1)).alias("support"))


def line_counts(lines: DataFrame) -> DataFrame:
    """How often each item stands in each order: ``site, user, group, item, lines``; N2 and N4 roll up from it."""
    return lines.groupBy(*_USER, "group", "item").agg(F.count(F.lit(1)).alias("lines"))


def raw_preference(support: DataFrame, totals: DataFrame, heavy_users: DataFrame | None = None) -> DataFrame:
    """``pref = ln(1 + support / total)`` (N5): ``site, user, item, pref``.

    The support rows of ``heavy_users`` are dealt over parts by item.
    """
    return dealt_join(support, totals, _USER, ["item"], heavy_users).select(
        *_USER, "item", F.ln(F.lit(1.0) + F.col("support").cast("double") / F.col("total").cast("double")).alias("pref"))


def item_max_preference(prefs: DataFrame) -> DataFrame:
    """Largest raw preference per item over all users and sites."""
    return prefs.groupBy("item").agg(F.max("pref").alias("max_pref"))


def scale_preferences(prefs: DataFrame, maxima: DataFrame, heavy_items: DataFrame | None = None) -> DataFrame:
    """Attach the item maximum (N7) and scale to 0..5, half up.

    The preferences of ``heavy_items`` are dealt over parts by user.
    """
    ratio = F.col("pref") / F.col("max_pref")
    return dealt_join(prefs, maxima, ["item"], _USER, heavy_items).select(
        *_USER, "item", half_up(F.lit(5.0) * ratio).cast("int").alias("score"))


def purchase_preferences(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """Full implicit pipeline (N10): order lines -> ``site, user, item, score``.

    A user or item with at least ``share`` of the lines is dealt over parts.
    """
    spark = lines.sparkSession
    counts, seen = written(line_counts(lines), "line-counts", users=key_sketch(_USER, share), items=key_sketch(["item"], share))
    heavy_users, heavy_items = (listed(spark, seen[k], seen["rows"], share) for k in ("users", "items"))
    support = counts.groupBy(*_USER, "item").agg(F.sum("lines").alias("support"))
    prefs = raw_preference(support, user_order_totals(counts), heavy_users)
    return scale_preferences(prefs, item_max_preference(prefs), heavy_items)


def purchase_ratings_explicit(ratings: DataFrame) -> DataFrame:
    """Given ratings passed through (N9): score truncated toward zero to int,
    time dropped, duplicates kept."""
    return ratings.select(*_USER, "item", F.col("score").cast("int").alias("score"))
