"""Registered field specs: a versioned table, looked up as of a time; else an XML file, else the bundled spec.

The table is append-only Parquet, one row per field of a version:
``key, version, valid_from, logical, source, type``.  A spec is registered under
any key (a site, a request name).  The version that holds at a time is the highest one
that is valid from then or earlier; a later registration never changes what an
earlier time gives.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.sources.fieldspec import FieldSpec, default_spec

SPECS = "key string, version int, valid_from timestamp, logical string, source string, type string"


def spec_table(spark: SparkSession, path: str) -> DataFrame:
    """All registered versions; empty if nothing has been registered yet."""
    try:
        return spark.read.schema(SPECS).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
        return spark.createDataFrame([], SPECS)


def register_spec(spark: SparkSession, path: str, key: str, spec: FieldSpec, valid_from: datetime) -> int:
    """Append ``spec`` as the next version of ``key``; returns its number.  Versions are valid from ever later times."""
    last = spec_table(spark, path).where(F.col("key") == key).agg(F.max("version").alias("version"), F.max("valid_from").alias("since")).first()
    if last["since"] is not None and valid_from < last["since"]:
        raise ValueError(f"spec of '{key}' is already valid from {last['since']}")
    if not spec.fields:
        raise ValueError("field spec has no fields")
    version = (last["version"] or 0) + 1
    rows = [(key, version, valid_from, name, source, kind) for name, (source, kind) in spec.fields.items()]
    spark.createDataFrame(rows, SPECS).coalesce(1).write.mode("append").parquet(path)
    return version


def registered_spec(spark: SparkSession, path: str, key: str, at: datetime) -> FieldSpec | None:
    """The spec of ``key`` that holds at a time, or None.  Only the rows of one key are read."""
    versions = spec_table(spark, path).where((F.col("key") == key) & (F.col("valid_from") <= F.lit(at)))
    rows = versions.join(versions.agg(F.max("version").alias("version")), "version").collect()  # one row per field
    return FieldSpec({r["logical"]: (r["source"], r["type"]) for r in rows}) if rows else None


def find_spec(spark: SparkSession, algorithm: str, explicit: bool, *, key: str | None = None, registry: str | None = None,
              at: datetime | None = None, xml: str | None = None) -> FieldSpec:
    """The registered spec of ``key`` as of ``at`` (default: now); without one the XML file; without that the bundled spec."""
    if registry is not None and key is not None:
        found = registered_spec(spark, registry, key, at or datetime.now())
        if found is not None:
            return found
    return FieldSpec.load(xml, spark) if xml else default_spec(algorithm, explicit)
