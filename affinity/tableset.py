"""Table sets that are whole or not there: parts, a manifest per part, one final marker.

A set is ``base/name/uid/`` with its parts ``1``, ``2``, ...  Beside them,
``manifest/`` holds a record that a build has started, one record per finished
part (row count, checksum, schema), and, last of all, the marker that commits the set.

* ``TableSet.write`` writes a part and records what the writing tasks saw.  A
  build that failed is run again with the same request: finished parts whose
  files still have their recorded rows are kept, the others are written again.
* ``read_set`` gives the parts of a committed set and refuses any other.
* A committed set is never written again; files that no build of this
  request has started are never overwritten.

Nothing is renamed, so the protocol holds on object stores, where a folder
cannot be moved in one step.  Two builds of one set at the same time are not kept apart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "part int, rows long, checksum string, fields string, sink string, request string"
STARTED, COMMITTED = "started", "committed"


class TableSetError(PySparkException):
    """A set that cannot be written or read as asked."""

    def __init__(self, message: str):
        super().__init__(message)


def set_root(base: str, name: str, uid: str) -> str:
    return f"{base.rstrip('/')}/{name}/{uid}"


def _record(spark: SparkSession, root: str, label: str):
    try:
        return spark.read.schema(RECORD).json(f"{root}/manifest/{label}").first()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
            return None
        raise


def is_committed(spark: SparkSession, base: str, name: str, uid: str) -> bool:
    """Whether a set has its final marker; lists files only."""
    try:
        return bool(spark.read.schema(RECORD).json(f"{set_root(base, name, uid)}/manifest/{COMMITTED}").inputFiles())
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
            return False
        raise


def _summary(df: DataFrame) -> list:
    """Row count and an order-free checksum over all columns."""
    hashed = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("checksum")]


class TableSet:
    """One build of a set: start, write the parts in order, commit."""

    def __init__(self, spark: SparkSession, base: str, name: str, uid: str, sink: str = "PARQUET", request: str = ""):
        from affinity.sinks import SINKS

        if sink.upper() not in SINKS:
            raise ValueError(f"unknown sink '{sink}', expected one of {SINKS}")
        self.spark, self.root, self.sink, self.request = spark, set_root(base, name, uid), sink.upper(), request
        self.kept: list[int] = []
        if _record(spark, self.root, COMMITTED):
            raise TableSetError(f"{self.root} is already built")
        started = _record(spark, self.root, STARTED)
        self.resumed = started is not None
        if self.resumed and (started["request"], started["sink"]) != (request, self.sink):
            raise TableSetError(f"{self.root} was started by another request")
        if not self.resumed:
            self._put(STARTED, (0, 0, "", "", self.sink, request))

    def path(self, part: int) -> str:
        return f"{self.root}/{part}"

    def _put(self, label, row):
        self.spark.createDataFrame([row], RECORD).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{label}")

    def write(self, part: int, df: DataFrame) -> DataFrame:
        """Write a part, unless an earlier run of this build has finished it; returns the part as it is stored."""
        from affinity.sinks import write_table

        done = _record(self.spark, self.root, str(part)) if self.resumed else None
        if done and done["fields"] == _fields(df.schema) and self._holds(done):
            self.kept.append(part)
            return _part(self.spark, self.root, done)
        seen = Observation()
        write_table(df.observe(seen, *_summary(df)), self.path(part), self.sink, "overwrite" if self.resumed else "errorifexists")
        row = (part, seen.get["rows"], seen.get["checksum"], _fields(df.schema), self.sink, self.request)
        self._put(str(part), row)
        return _part(self.spark, self.root, T.Row(**dict(zip(T._parse_datatype_string(RECORD).names, row, strict=True))))

    def _holds(self, record) -> bool:
        try:
            df = _part(self.spark, self.root, record)
            found = df.agg(*_summary(df)).first()
        except PySparkException:
            return False
        return (found["rows"], found["checksum"]) == (record["rows"], record["checksum"])

    def commit(self, parts: list[int]) -> dict[int, str]:
        """Write the final marker once every part has its record; returns the paths."""
        missing = [p for p in parts if _record(self.spark, self.root, str(p)) is None]
        if missing:
            raise TableSetError(f"{self.root} lacks parts {missing}")
        self._put(COMMITTED, (max(parts), len(parts), "", ",".join(map(str, parts)), self.sink, self.request))
        return {p: self.path(p) for p in parts}


def _fields(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _part(spark: SparkSession, root: str, record) -> DataFrame:
    from affinity.sinks import read_table

    return read_table(spark, f"{root}/{record['part']}", record["sink"], T._parse_datatype_string(record["fields"]))


def read_set(spark: SparkSession, base: str, name: str, uid: str) -> dict[int, DataFrame]:
    """The parts of a committed set by number; raises for a set that is not there or not finished."""
    root = set_root(base, name, uid)
    done = _record(spark, root, COMMITTED)
    if done is None:
        raise TableSetError(f"{root} is not a finished table set")
    return {int(p): _part(spark, root, _record(spark, root, p)) for p in done["fields"].split(",")}
