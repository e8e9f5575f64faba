"""Readers for engagement events and purchase lines (S1-S16) and dispatch.

Every reader ends in the same logical schema (``affinity.schemas``):

* events, implicit: site, user, item, event, timestamp
* events, explicit: site, user, item, event, score, timestamp
* purchase lines, implicit: site, user, group, timestamp, item
* purchase ratings, explicit: site, user, item, score, timestamp

Text files have no header and no quoting; fields are comma separated and a line
with the wrong number of fields fails the job.  Parquet, JDBC and JSON document
inputs go through a field mapping (``fieldspec``).  The document readers take
the place of a search-engine connector: records whose fields are all strings,
or nested documents, whose fields are given by paths and whose arrays can give
a row per element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity import schemas
from affinity.plans.materialize import written
from affinity.sources.strides import jdbc_predicates
from affinity.functions.columns import required, required_cast
from affinity.sources.fieldspec import FieldSpec, apply_field_spec, default_spec

# Column order of the text layouts.
EVENT_TEXT_EXPLICIT = ["site", "user", "item", "timestamp", "event", "score"]
EVENT_TEXT_IMPLICIT = ["site", "user", "item", "timestamp", "event"]
ORDER_TEXT_EXPLICIT = ["site", "timestamp", "user", "item", "score"]
ORDER_TEXT_IMPLICIT = ["site", "timestamp", "user", "group", "item"]

SOURCE_KINDS = ("FILE", "PARQUET", "JDBC", "ELASTIC")


def _event_schema(explicit: bool) -> T.StructType:
    return schemas.EVENT_RATING if explicit else schemas.EVENT


def _order_schema(explicit: bool) -> T.StructType:
    return schemas.PURCHASE_RATING if explicit else schemas.ORDER_LINE


# ---------------------------------------------------------------- text

def _fields(layout: list[str]) -> tuple:
    """Fields of a line as an array, and the columns by name."""
    # Trailing empty fields do not count, as with a plain string split.
    parts = F.split(F.regexp_replace(F.col("value"), ",+$", ""), ",", -1)
    return parts, {name: F.element_at(F.col("_f"), i + 1) for i, name in enumerate(layout)}


def _read_text(spark: SparkSession, path: str, layout: list[str], schema: T.StructType) -> DataFrame:
    parts, by_name = _fields(layout)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    checked = F.when(F.size(parts) != len(layout),
                     F.raise_error(F.concat(F.lit(f"expected {len(layout)} fields: "), F.col("value"), F.lit(" in "), F.col("_file")))
                     ).otherwise(parts)
    fields = lines.select(checked.alias("_f"))
    return fields.select(*[
        (required(by_name[f.name], f"field '{f.name}'") if f.dataType == T.StringType()
         else required_cast(by_name[f.name], f.dataType, f"field '{f.name}'")).alias(f.name)
        for f in schema.fields
    ])


def text_problems(spark: SparkSession, path: str, algorithm: str, explicit: bool = False) -> DataFrame:
    """The lines that the text reader of ``algorithm`` refuses: ``file, line, value, problem``, lines from 1.

    One task reads the lines of a block of a file in order, so a line's number is the
    lines of the file's earlier blocks and its place in its own.  The input is read
    once, and stored: another read could cut the files into other blocks.  Only the
    counts, a row per block, are summed and broadcast; no line is shuffled or sorted,
    and a task holds no more for a longer file.
    """
    if algorithm == "EPREF":
        layout, schema = (EVENT_TEXT_EXPLICIT if explicit else EVENT_TEXT_IMPLICIT), _event_schema(explicit)
    else:
        layout, schema = (ORDER_TEXT_EXPLICIT if explicit else ORDER_TEXT_IMPLICIT), _order_schema(explicit)
    parts, by_name = _fields(layout)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), "value", parts.alias("_f"))
    problem = F.when(F.size("_f") != len(layout), F.lit(f"expected {len(layout)} fields"))
    for f in schema.fields:
        field = F.get("_f", F.lit(layout.index(f.name)))  # null past the end of a short line
        problem = problem.when((field if f.dataType == T.StringType() else field.try_cast(f.dataType)).isNull(), F.lit(f"field '{f.name}'"))
    marked = lines.select("file", "_start", "_row", problem.alias("problem"), F.when(problem.isNotNull(), F.col("value")).alias("value"))
    kept, _ = written(marked, "lines")
    blocks = kept.groupBy("file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_ahead"))
    bad = kept.where("problem is not null").join(F.broadcast(starts), ["file", "_start"])
    return bad.select("file", (F.col("_ahead") + F.col("_row") + 1).alias("line"), "value", "problem")


def read_events_text(spark: SparkSession, path: str, explicit: bool = False) -> DataFrame:
    """``site,user,item,time,event[,score]`` lines."""
    layout = EVENT_TEXT_EXPLICIT if explicit else EVENT_TEXT_IMPLICIT
    return _read_text(spark, path, layout, _event_schema(explicit))


def read_orders_text(spark: SparkSession, path: str, explicit: bool = False) -> DataFrame:
    """``site,timestamp,user,group,item`` or ``site,timestamp,user,item,score`` lines."""
    layout = ORDER_TEXT_EXPLICIT if explicit else ORDER_TEXT_IMPLICIT
    return _read_text(spark, path, layout, _order_schema(explicit))


# ---------------------------------------------------------------- mapped DataFrames

def map_events(df: DataFrame, spec: FieldSpec | None = None, explicit: bool = False) -> DataFrame:
    """Any DataFrame of event records -> logical events, through ``spec``."""
    return apply_field_spec(df, spec or default_spec("EPREF", explicit), _event_schema(explicit))


def map_orders(df: DataFrame, spec: FieldSpec | None = None, explicit: bool = False) -> DataFrame:
    """Any DataFrame of order lines -> logical lines (or given ratings)."""
    return apply_field_spec(df, spec or default_spec("NPREF", explicit), _order_schema(explicit))


# ---------------------------------------------------------------- Parquet

def read_events_parquet(spark: SparkSession, path: str, spec: FieldSpec | None = None,
                        explicit: bool = False) -> DataFrame:
    return map_events(spark.read.parquet(path), spec, explicit)


def read_orders_parquet(spark: SparkSession, path: str, spec: FieldSpec | None = None,
                        explicit: bool = False) -> DataFrame:
    return map_orders(spark.read.parquet(path), spec, explicit)


# ---------------------------------------------------------------- JDBC

def jdbc_options(url: str, table: str, properties: dict | None = None, partition_column: str | None = None,
                 lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> dict[str, str]:
    """Reader options of a JDBC read: one query per stride of ``partition_column``.

    A read by one task must be asked for (``num_partitions=1``); without that,
    the partition column, its bounds and the number of partitions are required.
    """
    options = {"url": url, "dbtable": table, **{k: str(v) for k, v in (properties or {}).items()}}
    if num_partitions == 1 and partition_column is None:
        return options
    if partition_column is None or lower_bound is None or upper_bound is None or not num_partitions:
        raise ValueError("a JDBC read needs partition_column, lower_bound, upper_bound and num_partitions, "
                         "or num_partitions=1 for a read by one task")
    return {**options, "partitionColumn": partition_column, "lowerBound": str(lower_bound),
            "upperBound": str(upper_bound), "numPartitions": str(num_partitions)}


def _read_jdbc(spark: SparkSession, url, table, properties, partition_column, lower_bound, upper_bound, num_partitions) -> DataFrame:
    """By the given strides; without bounds by predicates of equal weight, planned from the column (``sources.strides``)."""
    if partition_column is not None and num_partitions and lower_bound is None and upper_bound is None:
        predicates = jdbc_predicates(spark, url, table, properties or {}, partition_column, num_partitions)
        return spark.read.jdbc(url, table, predicates=predicates, properties={k: str(v) for k, v in (properties or {}).items()})
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, properties, partition_column, lower_bound, upper_bound, num_partitions)).load()


def read_events_jdbc(spark: SparkSession, url: str, table: str, spec: FieldSpec | None = None,
                     explicit: bool = False, properties: dict | None = None, partition_column: str | None = None,
                     lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> DataFrame:
    df = _read_jdbc(spark, url, table, properties, partition_column, lower_bound, upper_bound, num_partitions)
    return map_events(df, spec, explicit)


def read_orders_jdbc(spark: SparkSession, url: str, table: str, spec: FieldSpec | None = None,
                     explicit: bool = False, properties: dict | None = None, partition_column: str | None = None,
                     lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> DataFrame:
    df = _read_jdbc(spark, url, table, properties, partition_column, lower_bound, upper_bound, num_partitions)
    return map_orders(df, spec, explicit)


# ---------------------------------------------------------------- documents

def is_path(source: str) -> bool:
    """Whether a field's source is a path into a nested document: ``$...`` from its root, ``@...`` from an element."""
    return source[:1] in ("$", "@")


def _read_nested(spark: SparkSession, source, keys: list[str], variant_column: str | None, each: str | None) -> DataFrame:
    """One column per path of ``keys``, as strings, from documents of any shape held as ``VARIANT``.

    ``source`` is a path of JSON lines, or a DataFrame with the documents in
    ``variant_column`` (``VARIANT``, or strings of JSON).  ``each`` is the path
    of an array: every element of it gives a row, and ``@`` paths start there.
    A document whose array is missing, null or empty gives no rows; a path that
    is missing or null gives a null; objects and arrays come as JSON text.
    """
    flat = [k for k in keys if not is_path(k)]
    if flat:
        raise ValueError(f"nested documents are read by paths ($... or @...), not by {flat}")
    if each is None and any(k.startswith("@") for k in keys):
        raise ValueError("paths from an element (@...) need the path of its array (each=)")
    if isinstance(source, DataFrame):
        if variant_column is None:
            raise ValueError("nested documents in a DataFrame need their column (variant_column=)")
        held = F.col(f"`{variant_column}`")
        if isinstance(source.select(held).schema[0].dataType, T.StringType):
            held = F.parse_json(held)
        docs = source.select(held.alias("_doc"))
    else:
        docs = spark.read.option("singleVariantColumn", "_doc").option("mode", "FAILFAST").json(source)
    if each is not None:
        docs = docs.select("_doc", F.explode(F.variant_get("_doc", each, "array<variant>")).alias("_each"))
    return docs.select(*[F.variant_get("_each" if k.startswith("@") else "_doc", f"${k[1:]}", "string").alias(k) for k in keys])


def _read_documents(spark: SparkSession, source, spec: FieldSpec, map_column: str | None = None,
                    variant_column: str | None = None, each: str | None = None) -> DataFrame:
    """JSON lines (path) or a DataFrame; every mapped field is read as a string.

    A DataFrame may hold each document as one ``map<string,string>`` column
    (``map_column``); fields are then looked up by key, and a missing key is a
    missing value.  Nested documents are read by paths, ``_read_nested``.
    """
    keys = list(dict.fromkeys(spec.sources()))
    if variant_column is not None or each is not None or any(map(is_path, keys)):
        return _read_nested(spark, source, keys, variant_column, each)
    if isinstance(source, DataFrame):
        if map_column is not None:
            return source.select(*[F.col(f"`{map_column}`").getItem(k).alias(k) for k in keys])
        # (explicit ratings need no order; a required field that is missing fails in the mapping)
        return source.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in keys if c in source.columns])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in dict.fromkeys(spec.sources())])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(source)


def read_events_documents(spark: SparkSession, source, spec: FieldSpec | None = None, explicit: bool = False,
                          map_column: str | None = None, variant_column: str | None = None, each: str | None = None) -> DataFrame:
    spec = spec or default_spec("EPREF", explicit)
    return map_events(_read_documents(spark, source, spec, map_column, variant_column, each), spec, explicit)


def read_orders_documents(spark: SparkSession, source, spec: FieldSpec | None = None, explicit: bool = False,
                          map_column: str | None = None, variant_column: str | None = None, each: str | None = None) -> DataFrame:
    spec = spec or default_spec("NPREF", explicit)
    return map_orders(_read_documents(spark, source, spec, map_column, variant_column, each), spec, explicit)


# ---------------------------------------------------------------- dispatch

_EVENT_READERS = {"FILE": read_events_text, "PARQUET": read_events_parquet,
                  "JDBC": read_events_jdbc, "ELASTIC": read_events_documents}
_ORDER_READERS = {"FILE": read_orders_text, "PARQUET": read_orders_parquet,
                  "JDBC": read_orders_jdbc, "ELASTIC": read_orders_documents}


def read_source(spark: SparkSession, algorithm: str, kind: str, explicit: bool, **kwargs) -> DataFrame:
    """Read input for ``algorithm`` (EPREF events, NPREF purchases) from ``kind``.

    ``kwargs`` go to the reader: ``path`` for FILE and PARQUET, ``source`` for
    ELASTIC, ``url``/``table``/... for JDBC, and ``spec`` for mapped kinds.
    """
    kind = kind.upper()
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown source '{kind}', expected one of {SOURCE_KINDS}")
    if algorithm not in ("EPREF", "NPREF"):
        raise ValueError(f"unknown algorithm '{algorithm}'")
    readers = _EVENT_READERS if algorithm == "EPREF" else _ORDER_READERS
    return readers[kind](spark, explicit=explicit, **kwargs)
