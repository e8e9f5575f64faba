"""Partitions of equal weight for reads by predicate, planned from the column itself.

Uniform strides between two bounds put most rows of a skewed column into a few
tasks.  Here counts per range come from the source (one small grouped query per
level); ranges with more than a partition's share are counted again in finer steps, down to
single values; neighbouring ranges are then joined up to the share.  The predicates
cover every row once, rows without a value in a predicate of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges that one level counts.
BINS = 256

#: Counts per bin of width ``step`` from ``low`` (included) to ``high`` (excluded).
Counter = Callable[[int, int, int], dict[int, int]]


def weighed_ranges(counts: Counter, low: int, high: int, share: float, bins: int = BINS) -> list[tuple[int, int, int]]:
    """``(from, to, rows)`` with rows in order; only single values weigh more than ``share``."""
    step = max(1, -(-(high - low) // bins))
    out = []
    for number, rows in sorted(counts(low, high, step).items()):
        start, end = low + number * step, min(high, low + (number + 1) * step)
        if rows > share and end - start > 1:
            out += weighed_ranges(counts, start, end, share, bins)
        elif rows:
            out.append((start, end, rows))
    return out


def joined_ranges(ranges: list[tuple[int, int, int]], share: float) -> list[int]:
    """Where neighbouring ranges are cut so that they weigh no more than ``share`` together."""
    starts, held = [], 0
    for start, _, rows in ranges:
        if not starts or held + rows > share:
            starts.append(start)
            held = 0
        held += rows
    return starts


def stride_predicates(counts: Counter, column: str, low: int | None, high: int | None, rows: int, partitions: int,
                      bins: int = BINS) -> list[str]:
    """SQL predicates of about ``rows / partitions`` rows each over a column with values ``low`` to ``high`` (both included).

    The first and the last are open, so rows that arrive outside the bounds meanwhile are read too.
    """
    nulls = f"{column} IS NULL"
    if low is None or not rows:
        return [nulls, f"{column} IS NOT NULL"]
    share = max(1.0, rows / partitions)
    edges = [None, *joined_ranges(weighed_ranges(counts, low, high + 1, share, bins), share)[1:], None]
    parts = []
    for start, end in zip(edges, edges[1:], strict=False):
        bounds = [f"{column} >= {start}"] if start is not None else []
        bounds += [f"{column} < {end}"] if end is not None else []
        parts.append(" AND ".join(bounds) or f"{column} IS NOT NULL")
    return [*parts, nulls]


# ------------------------------------------------------------------ where the counts come from

def bounds_query(table: str, column: str) -> str:
    """Least and largest value and the rows that have one."""
    return f"(SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT({column}) AS n FROM {table}) b"


def counts_query(table: str, column: str, low: int, high: int, step: int) -> str:
    """Rows per bin of a range, grouped by the database; plain SQL with integer arithmetic only."""
    bin_of = f"({column} - ({low}) - MOD({column} - ({low}), {step})) / {step}"
    return f"(SELECT {bin_of} AS bin, COUNT(*) AS n FROM {table} WHERE {column} >= {low} AND {column} < {high} GROUP BY {bin_of}) h"


def jdbc_predicates(spark: SparkSession, url: str, table: str, properties: dict, column: str, partitions: int) -> list[str]:
    """Predicates for a JDBC table; at most ``BINS`` rows per counting query reach the driver."""
    def ask(query):
        return spark.read.format("jdbc").options(url=url, dbtable=query, **{k: str(v) for k, v in properties.items()}).load().collect()

    [bounds] = ask(bounds_query(table, column))
    low, high = (None if v is None else int(v) for v in bounds[:2])
    return stride_predicates(lambda lo, hi, step: {int(b): int(n) for b, n in ask(counts_query(table, column, lo, hi, step))},
                             column, low, high, int(bounds[2]), partitions)


def table_predicates(df: DataFrame, column: str, partitions: int, bins: int = BINS) -> list[str]:
    """The same for a DataFrame with an integral column."""
    low, high, rows = df.agg(F.min(column), F.max(column), F.count(column)).first()

    def counts(lo, hi, step):
        inside = df.where((F.col(column) >= lo) & (F.col(column) < hi))
        return {r[0]: r[1] for r in inside.groupBy(F.expr(f"({column} - ({lo})) div {step}")).count().collect()}

    return stride_predicates(counts, column, low, high, rows, partitions, bins)
