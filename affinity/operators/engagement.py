"""Engagement ratings.

Per (site, user, item): positive events of code ``e`` are cancelled by events of
code ``-e``; the net count ``max(pos - neg, 0)`` of every code with net > 0 is
scored from the score table (the last score saturates); the best score wins,
ties going to the lower code.  The rating's time is the latest positive event of
the winning code, cancelled ones included.  Event 0 counts for nothing.

Plan shape: one aggregate by (site, user, item, |event|) with only counters and
a max in the buffer (partial aggregation combines hot keys map-side), a
broadcast join to the size-checked score table, and one aggregate by (site,
user, item) on primitive buffers (``max`` of a packed rank, ``max_by`` time), so
both stay hash aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.sources.scores import as_scores

__all__ = [
    "event_polarity",
    "event_support",
    "net_event_support",
    "score_events",
    "best_event",
    "engagement_ratings",
    "engagement_ratings_explicit",
]

_TRIPLE = ["site", "user", "item"]


def event_polarity(events: DataFrame) -> DataFrame:
    """Events split by sign (E2): ``polarity`` +1 or -1, ``code`` = |event|;
    event 0 is dropped."""
    return (events.where(F.col("event") != 0)
            .select(*_TRIPLE, "event", F.abs("event").alias("code"),
                    F.signum("event").cast("int").alias("polarity"), "timestamp"))


def event_support(events: DataFrame) -> DataFrame:
    """Counts per triple and event code (E3): ``site, user, item, event, pos,
    neg, latest`` with ``latest`` the time of the last positive event."""
    nonzero = events.where(F.col("event") != 0)
    return (nonzero.groupBy(*_TRIPLE, F.abs("event").alias("event"))
            .agg(F.count_if(F.col("event") > 0).alias("pos"),
                 F.count_if(F.col("event") < 0).alias("neg"),
                 F.max(F.when(F.col("event") > 0, F.col("timestamp"))).alias("latest")))


def net_event_support(support: DataFrame) -> DataFrame:
    """Positives net of their reversals (E4), only codes with net > 0 (E5)."""
    net = F.greatest(F.col("pos") - F.col("neg"), F.lit(0))
    return (support.select(*_TRIPLE, "event", net.alias("net"), "latest")
            .where(F.col("net") > 0))


def score_events(net: DataFrame, scores=None, on_unknown: str = "error") -> DataFrame:
    """Score each net count (E6): ``scores[min(net, len)]``, 1-based.

    An event code missing from the score table fails the job (E7) unless
    ``on_unknown="drop"``; so does a code listed twice.  The table may have any
    size: Spark broadcasts it if it is small.
    """
    if on_unknown not in ("error", "drop"):
        raise ValueError("on_unknown must be 'error' or 'drop'")
    table = as_scores(net.sparkSession, scores).select("event", "scores")
    table = table.join(table.groupBy("event").agg(F.count(F.lit(1)).alias("_listed")), "event")
    how = "inner" if on_unknown == "drop" else "left"
    joined = net.join(table, "event", how)
    pick = F.element_at(F.col("scores"), F.least(F.col("net"), F.size("scores")).cast("int"))
    rating = F.when(F.col("_listed") > 1,
                    F.raise_error(F.concat(F.lit("event is listed twice: "), F.col("event").cast("string"))))
    rating = rating.when(F.col("scores").isNull(),
                    F.raise_error(F.concat(F.lit("event is unknown: "), F.col("event").cast("string"))))
    rating = rating.when(F.size("scores") == 0,
                         F.raise_error(F.concat(F.lit("event has no scores: "), F.col("event").cast("string"))))
    rating = rating.otherwise(pick)
    return joined.select(*_TRIPLE, "event", "net", rating.cast("int").alias("rating"), "latest")


def best_event(scored: DataFrame) -> DataFrame:
    """Best scored code per triple (E8) and its latest time.

    Rank = rating in the high 32 bits, inverted code in the low 32 bits, so the
    maximum is the highest rating with the lowest code among equals.
    """
    rank = F.shiftleft(F.col("rating").cast("long"), 32) + (F.lit(2**31 - 1) - F.col("event").cast("long"))
    best = (scored.groupBy(*_TRIPLE)
            .agg(F.max(rank).alias("_rank"), F.max_by("latest", rank).alias("timestamp")))
    rating = F.shiftright(F.col("_rank"), 32)
    event = F.lit(2**31 - 1) - F.col("_rank").bitwiseAND(F.lit(0xFFFFFFFF))
    return best.select(*_TRIPLE, rating.cast("double").alias("rating"), "timestamp", event.cast("int").alias("event"))


def engagement_ratings(events: DataFrame, scores=None, on_unknown: str = "error") -> DataFrame:
    """Full implicit pipeline (E11): events -> ``site, user, item, rating,
    timestamp, event``; one row per triple with a positive net count."""
    scored = score_events(net_event_support(event_support(events)), scores, on_unknown)
    return best_event(scored)


def engagement_ratings_explicit(events: DataFrame) -> DataFrame:
    """Given event scores passed through (E10): columns reordered, all events
    (negative and zero too) and duplicates kept."""
    return events.select(*_TRIPLE, F.col("score").alias("rating"), "timestamp", "event")
