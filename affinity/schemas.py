"""Logical schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Order line before grouping (D2): one row per purchased item.
ORDER_LINE = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("item", T.IntegerType()),
])

# Given purchase rating.
PURCHASE_RATING = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

# Engagement event without score (D5) and with a given score.
EVENT = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("event", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
])
EVENT_RATING = T.StructType(EVENT.fields[:4] + [T.StructField("score", T.DoubleType())] + EVENT.fields[4:])

# Purchase preference output.
PURCHASE_PREFERENCE = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
])

# Engagement rating output.
ENGAGEMENT_RATING = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("event", T.IntegerType()),
])

# Index tables (D8, D9). The user index column is called ``row`` as in the
# original table layout, though it is a column offset in the feature matrix.
USER_INDEX = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("row", T.LongType()),
])
ITEM_INDEX = T.StructType([
    T.StructField("item", T.StringType()),
    T.StructField("col", T.LongType()),
])

# Feature matrix entry in coordinate form.
FEATURE_ENTRY = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("col", T.LongType()),
    T.StructField("cat", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

# Rated-items set of one user, shared by all of that user's matrix rows.
RATED_SET_ENTRY = T.StructType([
    T.StructField("user_row", T.LongType()),
    T.StructField("col", T.LongType()),
    T.StructField("cat", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

# Event score table.
EVENT_SCORE = T.StructType([
    T.StructField("event", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("scores", T.ArrayType(T.IntegerType())),
])
