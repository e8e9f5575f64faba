"""Heavy keys: which keys of a join hold a large share of the rows, and into how many parts each is dealt.

A mergeable frequent-items sketch of the keys' hashes finds every key with at
least ``SHARE`` of the rows; there are at most ``1 / SHARE`` of them, whatever the
table, so the list is small enough to gather and to broadcast.  A heavy key is dealt
over as many parts as it has shares; every other key joins as it is, and if no
key is heavy the join is a plain one.  Counts are estimates and keys are known by
their hash only: either can change where a row is joined, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the rows from which a key is heavy; no part of it is much larger than this share.
SHARE = 0.001
#: Keys that a sketch tracks, per heavy key: its counts are off by less than a share.
TRACKED = 10


def key_sketch(keys: Sequence[str], share: float = SHARE) -> Column:
    """Aggregate: the most frequent hashes of the key columns, with their estimated counts."""
    most = max(1, round(1 / share))
    return F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(most), F.lit(min(TRACKED * most, 1_000_000)))


def listed(spark: SparkSession, sketch, rows: int, share: float = SHARE) -> DataFrame | None:
    """``(_key, _parts)`` of the heavy keys in a sketch of ``rows`` rows, or None if there are none."""
    found = [(r["item"], -int(-r["count"] // (share * rows))) for r in sketch or () if rows and r["count"] >= share * rows]
    return spark.createDataFrame(found, "_key long, _parts int") if found else None


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE) -> DataFrame | None:
    """``(_key, _parts)`` of the heavy keys of ``df``, or None; one pass, in which only sketches move."""
    found = df.agg(F.count(F.lit(1)).alias("n"), key_sketch(keys, share).alias("top")).first()
    return listed(df.sparkSession, found["top"], found["n"], share)


def dealt_join(large: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of ``large`` to ``small``, which has one row per key.

    Rows of a heavy key are dealt over its parts by the columns ``by``; its one
    row of ``small`` is copied once per part.
    """
    keys = list(keys)
    if heavy is None:
        return large.join(small, keys)

    def with_parts(df):  # at most 1 / share rows are broadcast
        return df.withColumn("_key", F.xxhash64(*keys)).join(F.broadcast(heavy), "_key", "left").drop("_key")

    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = with_parts(large).withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    copied = with_parts(small).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"]).drop("_part")
