"""Field mapping (S19): logical field name -> source column and declared type.

A mapping is applied with one ``select``; the source may be a column name or any
Spark SQL expression over the input, so derived inputs need no extra pass.
Conversion to the logical type is strict: a value that does not convert, or a
missing value in a required field, fails the job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions.columns import epoch_millis, required, required_cast

# The two bundled field specifications (logical name, source
# column, declared type), for engagement events and for purchase lines.
EVENT_FIELDS = {
    "site": ("site", "String"),
    "timestamp": ("timestamp", "Long"),
    "user": ("user", "String"),
    "event": ("event", "Integer"),
    "item": ("item", "Integer"),
}
ITEM_FIELDS = {
    "site": ("site", "String"),
    "timestamp": ("timestamp", "Long"),
    "user": ("user", "String"),
    "group": ("order", "String"),
    "item": ("item", "Integer"),
}
# Explicit ratings also need a score; the bundled specs lack it.
SCORE_FIELD = {"score": ("score", "Double")}


@dataclass(frozen=True)
class FieldSpec:
    """Mapping of logical fields to source expressions."""

    fields: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def source(self, name: str) -> str:
        try:
            return self.fields[name][0]
        except KeyError:
            raise KeyError(f"field spec has no entry for '{name}'") from None

    def sources(self) -> list[str]:
        return [src for src, _ in self.fields.values()]

    def with_fields(self, **extra: tuple[str, str]) -> "FieldSpec":
        merged = dict(self.fields)
        merged.update(extra)
        return FieldSpec(merged)

    @staticmethod
    def of(mapping: Mapping[str, str | tuple[str, str]]) -> "FieldSpec":
        """From ``{logical: source}`` or ``{logical: (source, type)}``."""
        out = {}
        for name, value in mapping.items():
            out[name] = (value, "") if isinstance(value, str) else (value[0], value[1])
        return FieldSpec(out)

    @staticmethod
    def from_xml(text: str) -> "FieldSpec":
        """Parse ``<fieldspec><field name=".." type="..">source</field>..``."""
        root = ET.fromstring(text)
        fields = {}
        for node in root.iter("field"):
            name = node.get("name")
            if not name or not (node.text or "").strip():
                raise ValueError("field spec entry needs a name and a source column")
            fields[name] = (node.text.strip(), node.get("type", ""))
        if not fields:
            raise ValueError("field spec has no fields")
        return FieldSpec(fields)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "FieldSpec":
        """Read a spec file from any storage Spark reads."""
        return FieldSpec.from_xml(spark.read.text(path, wholetext=True).first()[0])


def default_spec(algorithm: str, explicit: bool) -> FieldSpec:
    """Bundled spec by algorithm (``EPREF`` events, else purchases)."""
    base = EVENT_FIELDS if algorithm == "EPREF" else ITEM_FIELDS
    spec = FieldSpec(dict(base))
    return spec.with_fields(**SCORE_FIELD) if explicit else spec


def _source_column(df: DataFrame, source: str) -> Column:
    if source in df.columns:
        return F.col(f"`{source}`")
    return F.expr(source)


def apply_field_spec(df: DataFrame, spec: FieldSpec, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto the logical ``schema`` through ``spec``.

    Every logical field is required.  ``timestamp`` becomes epoch milliseconds
    whatever the source type (timestamp, timestamp_ntz, date, number, string of
    digits); other fields are cast strictly to their logical type.
    """
    sources = {f.name: _source_column(df, spec.source(f.name)) for f in schema.fields}
    probe = df.select(*[c.alias(n) for n, c in sources.items()]).schema  # analysis only
    out = []
    for f in schema.fields:
        src, src_type = sources[f.name], probe[f.name].dataType
        what = f"field '{f.name}' (source {spec.source(f.name)})"
        if f.name == "timestamp" and isinstance(src_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            value = required(epoch_millis(src, src_type), what)
        elif src_type == f.dataType or _widening(src_type, f.dataType):
            value = required(src.cast(f.dataType), what)
        else:
            value = required_cast(src, f.dataType, what)
        out.append(value.alias(f.name))
    return df.select(*out)


_INTEGRAL_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def _widening(src: T.DataType, dst: T.DataType) -> bool:
    """Casts that never fail: to string from numbers, to a wider integer, or
    from an integer to double."""
    if isinstance(dst, T.StringType):
        return isinstance(src, (T.NumericType, T.BooleanType, T.StringType))
    if type(src) in _INTEGRAL_WIDTH and type(dst) in _INTEGRAL_WIDTH:
        return _INTEGRAL_WIDTH[type(src)] <= _INTEGRAL_WIDTH[type(dst)]
    return isinstance(dst, T.DoubleType) and isinstance(src, (T.IntegralType, T.FloatType, T.DoubleType))
