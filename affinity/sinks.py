"""Output tables (K1-K3).

Layout under ``base/name/uid/``: ``1`` ratings; for engagement also ``2`` user
index, ``3`` item index, ``4`` matrix entries and ``5`` rated-items sets.
Sinks: ``PARQUET`` (default) and ``FILE`` (CSV with a header; every value is
quoted, quotes are doubled, blanks, empty strings and line ends are kept, a null
is ``\\N``).  A set is committed as a whole (``tableset``); existing output is never
overwritten, a build that failed is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from affinity.plans.materialize import materialize
from affinity.tableset import TableSet

SINKS = ("PARQUET", "FILE")

#: The same for writing and reading, so that values come back as they were.
CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": "\\N", "emptyValue": "", "quote": '"', "escape": '"', "lineSep": "\n"}


def table_path(base: str, name: str, uid: str, part: int) -> str:
    return f"{base.rstrip('/')}/{name}/{uid}/{part}"


def write_table(df: DataFrame, path: str, sink: str = "PARQUET", mode: str = "errorifexists") -> None:
    sink = sink.upper()
    writer = df.write.mode(mode)
    if sink == "PARQUET":
        writer.parquet(path)
    elif sink == "FILE":
        writer.options(**CSV_OPTIONS, quoteAll="true").csv(path)
    else:
        raise ValueError(f"unknown sink '{sink}', expected one of {SINKS}")


def read_table(spark, path: str, sink: str, schema) -> DataFrame:
    if sink.upper() == "PARQUET":
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine="true", mode="FAILFAST").csv(path)


def write_purchase(prefs: DataFrame, base: str, name: str, uid: str, sink: str = "PARQUET", request: str = "") -> str:
    """K1: purchase preferences at ``base/name/uid/1``, as a committed set of one table."""
    tables = TableSet(prefs.sparkSession, base, name, uid, sink, request)
    tables.write(1, prefs)
    return tables.commit([1])[1]


def write_engagement(ratings: DataFrame, base: str, name: str, uid: str, sink: str = "PARQUET",
                     partitions: int | None = None, request: str = "") -> dict[int, str]:
    """K2: ratings, indexes and matrix as one committed set.

    The ratings are computed once, written, and read back; every other table is
    computed from them, so a build that is run again after a failure goes on from the same
    ratings even if the source has changed.
    """
    from affinity.operators.features import index_tables, prepare_own

    tables = TableSet(ratings.sparkSession, base, name, uid, sink, request)
    fixed = tables.write(1, ratings)
    if sink.upper() != "PARQUET":
        fixed = materialize(fixed)  # read several times below
    users, items = index_tables(fixed, partitions)
    users, items = tables.write(2, users), tables.write(3, items)
    ff = prepare_own(fixed, users, items, partitions)
    tables.write(4, ff.matrix())
    tables.write(5, ff.rated_block())
    return tables.commit([1, 2, 3, 4, 5])
