"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the full driver tables through ``sources.shop_tables``; no
row caps or id subsets.  Column names match ``affinity.oracle.ORACLE_SQL``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import engagement as E
from affinity.operators import features as FT
from affinity.operators import purchase as P
from affinity.sources import shop_tables as S
from affinity.sources.fieldspec import FieldSpec, apply_field_spec
from affinity.plans.materialize import materialize
from affinity.sources.orderlog import order_item_log
from affinity.sources.readers import (EVENT_TEXT_EXPLICIT, EVENT_TEXT_IMPLICIT, ORDER_TEXT_EXPLICIT, ORDER_TEXT_IMPLICIT, map_orders,
                                      read_events_documents, read_events_parquet, read_orders_documents, read_source, text_problems)
from affinity.sources.registry import find_spec, register_spec
from affinity.sources.scores import DEFAULT_EVENT_SCORES
from affinity.sources.strides import table_predicates
from affinity.job import PreferenceRequest, build
from affinity.session import checkpoint_dir
from affinity.sinks import write_purchase
from affinity.tableset import read_set
from affinity import schemas

Query = Callable[[SparkSession, str], DataFrame]

# Interval for the order-item log query; both ends are dates that occur.
LOG_SITE = "1-URGENT"
LOG_START = datetime(1996, 1, 1)
LOG_END = datetime(1998, 6, 30)


def _ntz(ts: datetime):
    return F.expr(f"TIMESTAMP_NTZ'{ts:%Y-%m-%d %H:%M:%S}'")


# ------------------------------------------------------------------ inputs

def lines_one_shop(spark, sf):
    return map_orders(S.order_lines_source(spark, sf), S.order_spec())


def lines_by_priority(spark, sf):
    return map_orders(S.order_lines_source(spark, sf), S.order_spec("o_orderpriority"))


def events(spark, sf):
    return read_events_parquet(spark, f"{sf}/events.parquet", S.EVENT_SPEC)


def events_explicit(spark, sf):
    return read_events_parquet(spark, f"{sf}/events.parquet", S.EVENT_SPEC_EXPLICIT, explicit=True)


def ratings(spark, sf):
    return E.engagement_ratings(events(spark, sf))


def ratings_explicit(spark, sf):
    return E.engagement_ratings_explicit(events_explicit(spark, sf))


def _prefs(spark, sf):
    lines = lines_one_shop(spark, sf)
    return P.raw_preference(P.item_support(lines), P.user_order_totals(lines))


# ``ln`` differs between engines in the last bit (fdlibm here, the C library in
# DuckDB), so the two queries that expose raw logarithms compare them at 9
# decimals; the library keeps full precision.
CHECK_DECIMALS = 9


def _q_raw_preference(spark, sf):
    return _prefs(spark, sf).withColumn("pref", F.round("pref", CHECK_DECIMALS))


def _q_item_max_preference(spark, sf):
    return P.item_max_preference(_prefs(spark, sf)).withColumn("max_pref", F.round("max_pref", CHECK_DECIMALS))


# ------------------------------------------------------------------ queries

def _q_order_item_log(spark, sf):
    return order_item_log(S.order_item_log_source(spark, sf), LOG_SITE, _ntz(LOG_START), _ntz(LOG_END))


def _q_apply_field_spec(spark, sf):
    return apply_field_spec(S.order_lines_source(spark, sf), S.order_spec("o_orderpriority"), schemas.ORDER_LINE)


def _q_read_orders_explicit(spark, sf):
    return map_orders(S.order_lines_source(spark, sf), S.ORDER_SPEC_EXPLICIT, explicit=True)


def _as_strings(df, mapped=False):
    """Logical records as documents: all-string columns, or one map column."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if not mapped:
        return text
    return text.select(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))]).alias("doc"))


def _q_order_documents(spark, sf, explicit=False, mapped=False):
    """Order lines given as documents; the document field of the order is ``order``."""
    lines = _q_read_orders_explicit(spark, sf) if explicit else lines_one_shop(spark, sf).withColumnRenamed("group", "order")
    return read_orders_documents(spark, _as_strings(lines, mapped), explicit=explicit, map_column="doc" if mapped else None)


def _q_event_documents(spark, sf, explicit=False, mapped=False):
    records = events_explicit(spark, sf) if explicit else events(spark, sf)
    return read_events_documents(spark, _as_strings(records, mapped), explicit=explicit, map_column="doc" if mapped else None)


def _q_order_item_log_kept(spark, sf):
    return order_item_log(S.order_item_log_source(spark, sf), LOG_SITE, _ntz(LOG_START), _ntz(LOG_END), drop_deleted=True)


# A score table without the two commonest codes: their events are dropped.
KNOWN_SCORES = [row for row in DEFAULT_EVENT_SCORES if row[0] not in (6, 7)]


def _q_score_known_events(spark, sf):
    return E.score_events(E.net_event_support(E.event_support(events(spark, sf))), KNOWN_SCORES, on_unknown="drop")


def _q_build_engagement(spark, sf):
    """The job path: one request, five written tables; the ratings as read back."""
    request = PreferenceRequest(uid=uuid.uuid4().hex, name="catalog", algorithm="EPREF", source="PARQUET",
                                output=checkpoint_dir(spark),
                                source_args={"path": f"{sf}/events.parquet", "spec": S.EVENT_SPEC})
    return spark.read.schema(schemas.ENGAGEMENT_RATING).parquet(build(request, spark)[1])


def _in_common(part, df, keys, numbers, value=None):
    """A table of a set in the columns that all of them fit in."""
    keys, numbers = [*keys, None, None, None][:3], [*numbers, None, None][:2]
    texts = [(F.col(c) if c else F.lit(None)).cast("string").alias(f"k{i}") for i, c in enumerate(keys, 1)]
    longs = [(F.col(c) if c else F.lit(None)).cast("long").alias(f"n{i}") for i, c in enumerate(numbers, 1)]
    return df.select(F.lit(part).alias("part"), *texts, *longs, (F.col(value) if value else F.lit(None)).cast("double").alias("value"))


#: Per table of an engagement set: text keys, numbers and the value.
SET_COLUMNS = {1: (("site", "user", "item"), ("timestamp", "event"), "rating"), 2: (("site", "user"), ("row",)), 3: (("item",), ("col",)),
               4: (("cat",), ("row", "col"), "value"), 5: (("cat",), ("user_row", "col"), "value")}


def _q_engagement_set(spark, sf):
    """The job path: all five tables of one committed set, as read back."""
    base, uid = checkpoint_dir(spark), uuid.uuid4().hex
    build(PreferenceRequest(uid=uid, name="set", algorithm="EPREF", source="PARQUET", output=base, sink="FILE",
                            source_args={"path": f"{sf}/events.parquet", "spec": S.EVENT_SPEC}), spark)
    parts = [_in_common(k, df, *SET_COLUMNS[k]) for k, df in sorted(read_set(spark, base, "set", uid).items())]
    return functools.reduce(DataFrame.unionByName, parts)


def _q_purchase_set(spark, sf):
    """Purchases through the CSV sink (K1, K3), as read back from the committed set."""
    base, uid = checkpoint_dir(spark), uuid.uuid4().hex
    write_purchase(P.purchase_preferences(lines_one_shop(spark, sf)), base, "csv", uid, "FILE")
    return read_set(spark, base, "csv", uid)[1]


def _as_text(df, layout):
    """Records as comma-separated text in a folder of its own; its path."""
    path = f"{checkpoint_dir(df.sparkSession)}/text-{uuid.uuid4().hex}"
    df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in layout])).write.text(path)
    return path


def _q_events_text(spark, sf, explicit=False):
    """Text input through the dispatch by source name."""
    layout = EVENT_TEXT_EXPLICIT if explicit else EVENT_TEXT_IMPLICIT
    path = _as_text((events_explicit if explicit else events)(spark, sf), layout)
    return read_source(spark, "EPREF", "FILE", explicit, path=path)


def _q_orders_text(spark, sf, explicit=False):
    """Text input through the dispatch by source name."""
    layout = ORDER_TEXT_EXPLICIT if explicit else ORDER_TEXT_IMPLICIT
    path = _as_text(_q_read_orders_explicit(spark, sf) if explicit else lines_one_shop(spark, sf), layout)
    return read_source(spark, "NPREF", "FILE", explicit, path=path)


#: A line loses its last field, or the number in one, where its item is divisible by these.
CUT_EVERY, BAD_EVERY = 97, 89


def _q_text_problems(spark, sf):
    """Lines of a damaged text input that its reader refuses (S10); places in files are left to the tests."""
    lines = lines_one_shop(spark, sf)
    fields = [F.when(F.col("item") % BAD_EVERY == 0, F.lit("x")).otherwise(F.col(c).cast("string")) if c == "timestamp" else F.col(c).cast("string")
              for c in ORDER_TEXT_IMPLICIT]
    text = F.when(F.col("item") % CUT_EVERY == 0, F.concat_ws(",", *fields[:-1])).otherwise(F.concat_ws(",", *fields))
    path = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex}"
    lines.select(text).write.text(path)
    return text_problems(spark, path, "NPREF").select("value", "problem")


def _q_orders_by_weight(spark, sf):
    """Order lines read partition by partition of equal weight, each line once (the predicates planned for S14)."""
    source = S.order_lines_source(spark, sf)
    parts = [source.where(p) for p in table_predicates(source, "o_custkey", 5, bins=8)]
    return map_orders(functools.reduce(DataFrame.unionByName, parts), S.order_spec())


def _q_events_json(spark, sf):
    """JSON documents through the dispatch by source name."""
    path = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    _as_strings(events(spark, sf)).write.json(path)
    return read_source(spark, "EPREF", "ELASTIC", False, source=path)


#: Nested documents: a message per event, and a document per order whose lines are an array.
EVENT_PATHS = FieldSpec.of({"site": "$.shop.id", "user": "$.visitor['id no']", "item": "$.action.item",
                            "event": "$.action.code", "timestamp": "$.seen[0]"})
SCORED_PATHS = EVENT_PATHS.with_fields(score=("$.action.score", "Double"))
ORDER_PATHS = FieldSpec.of({"site": "$.shop", "user": "$.customer.id", "group": "$.order", "timestamp": "$.customer.time",
                            "item": "@.article.id"})


def _q_nested_events(spark, sf, explicit=False):
    """Events read by paths from JSON messages of several levels (S7, S8, through the dispatch)."""
    action = ["item", F.col("event").alias("code"), *(["score"] if explicit else [])]
    messages = (events_explicit(spark, sf) if explicit else events(spark, sf)).select(
        F.struct(F.col("site").alias("id")).alias("shop"), F.struct(F.col("user").alias("id no")).alias("visitor"),
        F.struct(*action).alias("action"), F.array("timestamp").alias("seen"))
    path = f"{checkpoint_dir(spark)}/nested-{uuid.uuid4().hex}"
    messages.write.json(path)
    return read_source(spark, "EPREF", "ELASTIC", explicit, source=path, spec=SCORED_PATHS if explicit else EVENT_PATHS)


def _q_nested_orders(spark, sf):
    """Order lines from one document per order, a row for every element of its lines."""
    line = F.struct(F.struct(F.col("item").alias("id")).alias("article"))
    orders = lines_one_shop(spark, sf).groupBy(F.col("site").alias("shop"), F.struct(F.col("user").alias("id"), F.col("timestamp").alias("time"))
                                               .alias("customer"), F.col("group").alias("order")).agg(F.collect_list(line).alias("lines"))
    docs = orders.select(F.to_variant_object(F.struct("*")).alias("doc"))
    return read_orders_documents(spark, docs, ORDER_PATHS, variant_column="doc", each="$.lines")


def _q_xml_scores(spark, sf):
    """Events scored by a score table that is read from XML."""
    path = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    rows = [f"<EventScore><type>{e}</type><description>{d}</description><scores>{','.join(map(str, s))}</scores></EventScore>"
            for e, d, s in DEFAULT_EVENT_SCORES]
    spark.createDataFrame([("<EventScores>" + "".join(rows) + "</EventScores>",)], "value string").coalesce(1).write.text(path)
    return E.score_events(E.net_event_support(E.event_support(events(spark, sf))), path)


#: Items per row of the nested sequences here: small, so that most users have several rows.
NESTED_ITEMS = 16
# Two versions of one registered spec, and the time between them.
SPEC_TIMES = (datetime(2020, 1, 1), datetime(2021, 1, 1), datetime(2022, 1, 1))


def _q_registered_spec(spark, sf):
    """Order lines through the spec that was registered as of a time (S19): the first of two versions."""
    path = f"{checkpoint_dir(spark)}/specs-{uuid.uuid4().hex}"
    register_spec(spark, path, "shop", S.order_spec("o_orderpriority"), SPEC_TIMES[0])
    register_spec(spark, path, "shop", S.order_spec(), SPEC_TIMES[2])
    spec = find_spec(spark, "NPREF", False, key="shop", registry=path, at=SPEC_TIMES[1])
    return apply_field_spec(S.order_lines_source(spark, sf), spec, schemas.ORDER_LINE)


def _q_extended_index(spark, sf, index):
    """An index of the ratings of the first half of the time, extended by the rest of them."""
    rated = materialize(ratings(spark, sf))
    begin, end = FT.observation_interval(rated).first()
    return index(rated, known=index(rated.where(F.col("timestamp") < (begin + end) // 2)))


def _features(spark, sf, explicit=False):
    return FT.prepare(ratings_explicit(spark, sf) if explicit else ratings(spark, sf))


QUERIES: dict[str, Query] = {
    # sources
    "read_events_parquet": events,
    "read_events_parquet_explicit": events_explicit,
    "read_orders_parquet": lines_one_shop,
    "read_orders_parquet_explicit": _q_read_orders_explicit,
    "read_events_documents": _q_event_documents,
    "read_events_documents_explicit": lambda s, sf: _q_event_documents(s, sf, explicit=True),
    "read_events_documents_map": lambda s, sf: _q_event_documents(s, sf, mapped=True),
    "read_orders_documents": _q_order_documents,
    "read_orders_documents_explicit": lambda s, sf: _q_order_documents(s, sf, explicit=True),
    "read_orders_documents_map": lambda s, sf: _q_order_documents(s, sf, mapped=True),
    "read_events_text": _q_events_text,
    "read_events_text_explicit": lambda s, sf: _q_events_text(s, sf, explicit=True),
    "read_orders_text": _q_orders_text,
    "read_orders_text_explicit": lambda s, sf: _q_orders_text(s, sf, explicit=True),
    "read_events_json": _q_events_json,
    "read_events_nested": _q_nested_events,
    "read_events_nested_explicit": lambda s, sf: _q_nested_events(s, sf, explicit=True),
    "read_orders_nested": _q_nested_orders,
    "text_problems": _q_text_problems,
    "read_orders_by_weight": _q_orders_by_weight,
    "order_item_log": _q_order_item_log,
    "order_item_log_kept": _q_order_item_log_kept,
    "apply_field_spec": _q_apply_field_spec,
    "apply_registered_spec": _q_registered_spec,
    # purchase preferences
    "build_transactions": lambda s, sf: P.build_transactions(lines_one_shop(s, sf)),
    "nested_transactions": lambda s, sf: P.unnest_transactions(P.nested_transactions(lines_one_shop(s, sf), NESTED_ITEMS)),
    "user_order_totals": lambda s, sf: P.user_order_totals(lines_one_shop(s, sf)),
    "explode_transactions": lambda s, sf: P.explode_transactions(lines_one_shop(s, sf)),
    "item_support": lambda s, sf: P.item_support(lines_one_shop(s, sf)),
    "raw_preference": _q_raw_preference,
    "item_max_preference": _q_item_max_preference,
    "purchase_preferences": lambda s, sf: P.purchase_preferences(lines_one_shop(s, sf)),
    "purchase_ratings_explicit": lambda s, sf: P.purchase_ratings_explicit(_q_read_orders_explicit(s, sf)),
    "build_purchase_preferences": lambda s, sf: P.purchase_preferences(lines_by_priority(s, sf)),
    # engagement ratings
    "event_polarity": lambda s, sf: E.event_polarity(events(s, sf)),
    "event_support": lambda s, sf: E.event_support(events(s, sf)),
    "net_event_support": lambda s, sf: E.net_event_support(E.event_support(events(s, sf))),
    "score_events": lambda s, sf: E.score_events(E.net_event_support(E.event_support(events(s, sf)))),
    "score_known_events": _q_score_known_events,
    "engagement_ratings": lambda s, sf: E.best_event(
        E.score_events(E.net_event_support(E.event_support(events(s, sf))))),
    "build_engagement_ratings": _q_build_engagement,
    "engagement_ratings_explicit": ratings_explicit,
    "score_events_xml": _q_xml_scores,
    # committed table sets
    "build_engagement_set": _q_engagement_set,
    "build_purchase_set": _q_purchase_set,
    # feature matrix
    "observation_interval": lambda s, sf: FT.observation_interval(ratings(s, sf)),
    "user_index": lambda s, sf: FT.user_index(ratings(s, sf)),
    "item_index": lambda s, sf: FT.item_index(ratings(s, sf)),
    "extended_user_index": lambda s, sf: _q_extended_index(s, sf, FT.user_index),
    "extended_item_index": lambda s, sf: _q_extended_index(s, sf, FT.item_index),
    "feature_layout": lambda s, sf: _features(s, sf).layout(),
    "feature_user_block": lambda s, sf: _features(s, sf).user_block(),
    "feature_item_block": lambda s, sf: _features(s, sf).item_block(),
    "feature_rated_block": lambda s, sf: _features(s, sf).rated_block(),
    "feature_previous_block": lambda s, sf: _features(s, sf).previous_block(),
    "feature_time_block": lambda s, sf: _features(s, sf).time_block(),
    "feature_event_block": lambda s, sf: _features(s, sf).event_block(),
    "feature_label": lambda s, sf: _features(s, sf).label(),
    "rating_rows": lambda s, sf: _features(s, sf).rating_rows(),
    "feature_matrix": lambda s, sf: _features(s, sf).matrix(),
    "feature_matrix_explicit": lambda s, sf: _features(s, sf, explicit=True).matrix(),
    "feature_rated_block_explicit": lambda s, sf: _features(s, sf, explicit=True).rated_block(),
}

FLAGSHIP = "purchase_preferences"
