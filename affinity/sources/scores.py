"""Event score table (S20): event code -> scores by net event count.

A rating for ``n`` net events of code ``e`` is ``scores[min(n, len(scores))]``
(1-based), so the last score saturates.  Negative codes are reversals and carry
no scores.  A code must be listed once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions.columns import strict_cast
from affinity.schemas import EVENT_SCORE

# Default event score table (code, description, scores by count).
DEFAULT_EVENT_SCORES = [
    (1, "purchased", [100]),
    (2, "joined checkout", [85]),
    (3, "placed in shopping cart", [60]),
    (4, "placed in wishlist", [40]),
    (5, "browsed from search result", [25, 32, 38, 43, 47]),
    (6, "browsed for recommendation list", [15, 21, 26, 30, 33]),
    (7, "browsed", [5, 12, 17, 21, 24]),
    (-1, "returned", []),
    (-2, "left checkout", []),
    (-3, "removed from shopping cart", []),
    (-4, "removed from wish list", []),
]


def default_scores(spark: SparkSession) -> DataFrame:
    return scores_from_rows(spark, DEFAULT_EVENT_SCORES)


def scores_from_rows(spark: SparkSession, rows) -> DataFrame:
    """A score table from (event, description, scores) rows, as a local relation whose size Spark knows."""
    columns = zip(("event", "description", "scores"), zip(*rows, strict=True), strict=True)
    kinds = {"event": pa.int32(), "description": pa.string(), "scores": pa.list_(pa.int32())}
    return spark.createDataFrame(pa.table({name: pa.array(values, kinds[name]) for name, values in columns}), EVENT_SCORE)


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    """Read ``<EventScores><EventScore><type/><description/><scores>a,b</scores>``.

    Empty ``scores`` give an empty list; every entry is kept.
    """
    raw = (spark.read.format("xml").option("rowTag", "EventScore")
           .schema("type string, description string, scores string").load(path))
    parts = F.split(F.trim(F.coalesce(F.col("scores"), F.lit(""))), r"\s*,\s*")
    return raw.select(
        strict_cast(F.trim(F.col("type")), T.IntegerType(), "score type").alias("event"),
        F.col("description"),
        F.when(F.trim(F.coalesce(F.col("scores"), F.lit(""))) == "", F.array().cast("array<int>"))
        .otherwise(F.transform(parts, lambda s: strict_cast(s, T.IntegerType(), "score"))).alias("scores"),
    )


def as_scores(spark: SparkSession, scores) -> DataFrame:
    """Accept None (default table), a DataFrame, a path, or rows."""
    if scores is None:
        return default_scores(spark)
    if isinstance(scores, DataFrame):
        return scores
    if isinstance(scores, str):
        return load_scores(spark, scores)
    return scores_from_rows(spark, scores)
