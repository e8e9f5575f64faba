"""DuckDB SQL equal to each registered query (tables are pre-registered views).

Cross-engine notes: epoch milliseconds use ``epoch_us(ts) // 1000`` (floored,
as Spark); double-to-int casts use ``trunc``/``floor`` first (DuckDB rounds);
every output column is cast to the Spark result type.
"""

from __future__ import annotations

from datetime import datetime

from affinity.catalog import BAD_EVERY, CUT_EVERY, LOG_END, LOG_SITE, LOG_START, NESTED_ITEMS, SET_COLUMNS
from affinity.sources.scores import DEFAULT_EVENT_SCORES


def _ms(col: str) -> str:
    return f"CAST(epoch_us({col}) // 1000 AS BIGINT)"


def _ts(ts: datetime) -> str:
    return f"TIMESTAMP '{ts:%Y-%m-%d %H:%M:%S}'"


_EVENT_CODE = (
    "CASE event_type"
    " WHEN 'view' THEN 7"
    " WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 5 ELSE 6 END"
    " WHEN 'signup' THEN CASE event_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 7 END"
    " WHEN 'purchase' THEN CASE WHEN event_id % 16 = 0 THEN 1 ELSE 6 END"
    " WHEN 'error' THEN -(1 + event_id % 7) END"
)

_SCORES = ", ".join(f"({e}, CAST([{', '.join(map(str, s))}] AS INTEGER[]))" for e, _, s in DEFAULT_EVENT_SCORES)


def _lines(site: str) -> str:
    return f"""lines AS (
  SELECT CAST({site} AS VARCHAR) AS site, CAST(o.o_custkey AS VARCHAR) AS "user",
         CAST(o.o_orderkey AS VARCHAR) AS "group", {_ms('o.o_orderdate')} AS "timestamp",
         CAST(l.l_partkey AS INTEGER) AS item
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


_PREFS = """totals AS (SELECT site, "user", CAST(COUNT(DISTINCT "group") AS BIGINT) AS total FROM lines GROUP BY site, "user"),
support AS (SELECT site, "user", item, CAST(COUNT(*) AS BIGINT) AS support FROM lines GROUP BY site, "user", item),
prefs AS (
  SELECT s.site, s."user", s.item, ln(1.0 + CAST(s.support AS DOUBLE) / CAST(t.total AS DOUBLE)) AS pref
  FROM support s JOIN totals t ON s.site = t.site AND s."user" = t."user"),
maxp AS (SELECT item, max(pref) AS max_pref FROM prefs GROUP BY item)"""

_SCALE = """SELECT p.site, p."user", p.item, CAST(floor(5.0 * (p.pref / m.max_pref) + 0.5) AS INTEGER) AS score
FROM prefs p JOIN maxp m ON p.item = m.item"""

_EVENTS = f"""ev AS (
  SELECT 'site' || CAST(user_id % 3 AS VARCHAR) AS site, CAST(user_id AS VARCHAR) AS "user",
         'i' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS VARCHAR) AS item,
         CAST({_EVENT_CODE} AS INTEGER) AS event, CAST(value AS DOUBLE) AS score, {_ms('ts')} AS "timestamp"
  FROM events)"""

_SUPPORT = """sup AS (
  SELECT site, "user", item, CAST(abs(event) AS INTEGER) AS event,
         CAST(count(*) FILTER (WHERE event > 0) AS BIGINT) AS pos,
         CAST(count(*) FILTER (WHERE event < 0) AS BIGINT) AS neg,
         CAST(max("timestamp") FILTER (WHERE event > 0) AS BIGINT) AS latest
  FROM ev WHERE event <> 0 GROUP BY site, "user", item, abs(event))"""

_NET = """net AS (
  SELECT site, "user", item, event, CAST(greatest(pos - neg, 0) AS BIGINT) AS net, latest
  FROM sup WHERE greatest(pos - neg, 0) > 0)"""

_SCORED = f"""sc(event, scores) AS (VALUES {_SCORES}),
scored AS (
  SELECT n.site, n."user", n.item, n.event, n.net,
         CAST(s.scores[CAST(least(n.net, len(s.scores)) AS INTEGER)] AS INTEGER) AS rating, n.latest
  FROM net n JOIN sc s ON n.event = s.event)"""

_RATINGS = """ratings AS (
  SELECT site, "user", item, CAST(rating AS DOUBLE) AS rating, latest AS "timestamp", event FROM (
    SELECT *, row_number() OVER (PARTITION BY site, "user", item ORDER BY rating DESC, event ASC) AS rn
    FROM scored) WHERE rn = 1)"""

_RATINGS_EXPLICIT = """ratings AS (
  SELECT site, "user", item, score AS rating, "timestamp", event FROM ev)"""


def _features(ratings_cte: str) -> str:
    return f"""users AS (
  SELECT site, "user", CAST(row_number() OVER (ORDER BY site, "user") - 1 AS BIGINT) AS "row"
  FROM (SELECT DISTINCT site, "user" FROM ratings)),
items AS (
  SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS BIGINT) AS col
  FROM (SELECT DISTINCT item FROM ratings)),
dims AS (
  SELECT (SELECT count(*) FROM users) AS nu, (SELECT count(*) FROM items) AS ni,
         (SELECT min("timestamp") FROM ratings) AS t0),
indexed AS (
  SELECT u."row" AS urow, i.col AS icol, r."timestamp", r.event, r.rating
  FROM ratings r JOIN users u ON r.site = u.site AND r."user" = u."user" JOIN items i ON r.item = i.item),
keys AS (
  SELECT urow, "timestamp", icol, lag(icol) OVER (PARTITION BY urow ORDER BY "timestamp", icol) AS prev_col
  FROM (SELECT DISTINCT urow, "timestamp", icol FROM indexed)),
rows AS (
  SELECT CAST(row_number() OVER (ORDER BY x.urow, x."timestamp", x.icol, x.event, x.rating) - 1 AS BIGINT) AS "row",
         x.urow, x.icol, x."timestamp", x.event, x.rating, k.prev_col
  FROM indexed x JOIN keys k ON x.urow = k.urow AND x."timestamp" = k."timestamp" AND x.icol = k.icol),
blocks AS (
  SELECT "row", CAST(urow AS BIGINT) AS col, 'user' AS cat, 1.0::DOUBLE AS value FROM rows
  UNION ALL SELECT "row", nu + icol, 'item', 1.0::DOUBLE FROM rows, dims
  UNION ALL SELECT "row", nu + 2 * ni + prev_col, 'context_categorical', 1.0::DOUBLE FROM rows, dims
            WHERE prev_col IS NOT NULL
  UNION ALL SELECT "row", nu + 3 * ni, 'context_numerical',
            CAST(("timestamp" - t0) // 86400000 AS DOUBLE) FROM rows, dims
  UNION ALL SELECT "row", nu + 3 * ni + 1, 'context_numerical', CAST(event AS DOUBLE) FROM rows, dims
  UNION ALL SELECT "row", nu + 3 * ni + 2, 'label', CAST(rating AS DOUBLE) FROM rows, dims),
rated AS (
  SELECT x.urow AS user_row, CAST(d.nu + d.ni + x.icol AS BIGINT) AS col, 'context_categorical_set' AS cat,
         CAST(1 AS DOUBLE) / CAST(c.n AS DOUBLE) AS value
  FROM indexed x JOIN (SELECT urow, count(*) AS n FROM indexed GROUP BY urow) c ON x.urow = c.urow, dims d)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_ONE = "'shop'"
_L1 = _lines(_ONE)
_LP = _lines("o.o_orderpriority")
_EP = [_EVENTS, _SUPPORT, _NET, _SCORED, _RATINGS]
_FEAT = _with(*_EP, _features(""))
_FEAT_X = _with(_EVENTS, _RATINGS_EXPLICIT, _features(""))


def _block(where: str) -> str:
    return _FEAT + f'SELECT "row", CAST(col AS BIGINT) AS col, cat, value FROM blocks WHERE {where}'


ORACLE_SQL: dict[str, str] = {
    "read_events_parquet": _with(_EVENTS) + 'SELECT site, "user", item, event, "timestamp" FROM ev',
    "read_events_parquet_explicit": _with(_EVENTS) + 'SELECT site, "user", item, event, score, "timestamp" FROM ev',
    "read_orders_parquet": _with(_L1) + 'SELECT site, "user", "group", "timestamp", item FROM lines',
    "read_orders_parquet_explicit": f"""SELECT CAST('shop' AS VARCHAR) AS site, CAST(o.o_custkey AS VARCHAR) AS "user",
  CAST(l.l_partkey AS INTEGER) AS item, CAST(l.l_extendedprice / 1000 AS DOUBLE) AS score,
  {_ms('o.o_orderdate')} AS "timestamp"
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "order_item_log": f"""SELECT o.o_orderpriority AS idsite, o.o_custkey AS idvisitor, o.o_orderdate AS server_time,
  o.o_orderkey AS idorder, l.l_partkey AS idaction_sku, l.l_extendedprice AS price, l.l_quantity AS quantity,
  (l.l_returnflag = 'R') AS deleted
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderpriority = '{LOG_SITE}' AND o.o_orderdate > {_ts(LOG_START)} AND o.o_orderdate < {_ts(LOG_END)}""",
    "order_item_log_kept": f"""SELECT o.o_orderpriority AS idsite, o.o_custkey AS idvisitor, o.o_orderdate AS server_time,
  o.o_orderkey AS idorder, l.l_partkey AS idaction_sku, l.l_extendedprice AS price, l.l_quantity AS quantity, false AS deleted
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderpriority = '{LOG_SITE}' AND o.o_orderdate > {_ts(LOG_START)} AND o.o_orderdate < {_ts(LOG_END)}
  AND l.l_returnflag <> 'R'""",
    "apply_field_spec": _with(_LP) + 'SELECT site, "user", "group", "timestamp", item FROM lines',
    "build_transactions": _with(_L1) + """, ord AS (
  SELECT site, "user", "group", min("timestamp") AS "timestamp" FROM lines GROUP BY site, "user", "group"),
seq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY site, "user" ORDER BY "timestamp", "group") - 1 AS BIGINT) AS seq
  FROM ord)
SELECT l.site, l."user", s.seq, l."group", s."timestamp", l.item
FROM lines l JOIN seq s ON l.site = s.site AND l."user" = s."user" AND l."group" = s."group\"""",
    "user_order_totals": _with(_L1, _PREFS) + 'SELECT site, "user", total FROM totals',
    "explode_transactions": _with(_L1) + 'SELECT site, "user", item FROM lines',
    "item_support": _with(_L1, _PREFS) + 'SELECT site, "user", item, support FROM support',
    "raw_preference": _with(_L1, _PREFS) + 'SELECT site, "user", item, round(pref, 9) AS pref FROM prefs',
    "item_max_preference": _with(_L1, _PREFS) + "SELECT item, round(max_pref, 9) AS max_pref FROM maxp",
    "purchase_preferences": _with(_L1, _PREFS) + _SCALE,
    "purchase_ratings_explicit": """SELECT CAST('shop' AS VARCHAR) AS site, CAST(o.o_custkey AS VARCHAR) AS "user",
  CAST(l.l_partkey AS INTEGER) AS item, CAST(trunc(l.l_extendedprice / 1000) AS INTEGER) AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "build_purchase_preferences": _with(_LP, _PREFS) + _SCALE,
    "event_polarity": _with(_EVENTS) + """SELECT site, "user", item, event, CAST(abs(event) AS INTEGER) AS code,
  CAST(sign(event) AS INTEGER) AS polarity, "timestamp" FROM ev WHERE event <> 0""",
    "event_support": _with(_EVENTS, _SUPPORT) + 'SELECT * FROM sup',
    "net_event_support": _with(_EVENTS, _SUPPORT, _NET) + 'SELECT * FROM net',
    "score_events": _with(_EVENTS, _SUPPORT, _NET, _SCORED) + 'SELECT * FROM scored',
    "score_known_events": _with(_EVENTS, _SUPPORT, _NET, _SCORED) + "SELECT * FROM scored WHERE event NOT IN (6, 7)",
    "engagement_ratings": _with(*_EP) + 'SELECT * FROM ratings',
    "build_engagement_ratings": _with(*_EP) + 'SELECT * FROM ratings',
    "engagement_ratings_explicit": _with(_EVENTS, _RATINGS_EXPLICIT) + 'SELECT * FROM ratings',
    "observation_interval": _with(*_EP) + 'SELECT min("timestamp") AS "begin", max("timestamp") AS "end" FROM ratings',
    "user_index": _FEAT + 'SELECT site, "user", "row" FROM users',
    "item_index": _FEAT + "SELECT item, col FROM items",
    "feature_layout": _FEAT + """SELECT CAST(nu AS BIGINT) AS users, CAST(ni AS BIGINT) AS items,
  CAST(0 AS BIGINT) AS user_offset, CAST(nu AS BIGINT) AS item_offset, CAST(nu + ni AS BIGINT) AS rated_offset,
  CAST(nu + 2 * ni AS BIGINT) AS previous_offset, CAST(nu + 3 * ni AS BIGINT) AS time_col,
  CAST(nu + 3 * ni + 1 AS BIGINT) AS event_col, CAST(nu + 3 * ni + 2 AS BIGINT) AS label_col FROM dims""",
    "feature_user_block": _block("cat = 'user'"),
    "feature_item_block": _block("cat = 'item'"),
    "feature_rated_block": _FEAT + "SELECT * FROM rated",
    "feature_previous_block": _block("cat = 'context_categorical'"),
    "feature_time_block": _FEAT + """SELECT "row", CAST(nu + 3 * ni AS BIGINT) AS col, 'context_numerical' AS cat,
  CAST(("timestamp" - t0) // 86400000 AS DOUBLE) AS value FROM rows, dims""",
    "feature_event_block": _FEAT + """SELECT "row", CAST(nu + 3 * ni + 1 AS BIGINT) AS col, 'context_numerical' AS cat,
  CAST(event AS DOUBLE) AS value FROM rows, dims""",
    "feature_label": _block("cat = 'label'"),
    "rating_rows": _FEAT + 'SELECT "row", urow, icol, "timestamp", event, rating FROM rows',
    "feature_matrix": _block("true"),
    "feature_matrix_explicit": _FEAT_X + 'SELECT "row", CAST(col AS BIGINT) AS col, cat, value FROM blocks',
    "feature_rated_block_explicit": _FEAT_X + "SELECT * FROM rated",
}


def _numbered(keys: str, name: str) -> str:
    """Keys of the first half of the time in sorted order, then the others in sorted order."""
    return f"""SELECT {keys}, CAST(row_number() OVER (ORDER BY late, {keys}) - 1 AS BIGINT) AS {name}
FROM (SELECT {keys}, min(CASE WHEN "timestamp" < mid THEN 0 ELSE 1 END) AS late
      FROM ratings, (SELECT (min("timestamp") + max("timestamp")) // 2 AS mid FROM ratings) GROUP BY {keys})"""


ORACLE_SQL["extended_user_index"] = _with(*_EP) + _numbered('site, "user"', '"row"')
ORACLE_SQL["extended_item_index"] = _with(*_EP) + _numbered("item", "col")
ORACLE_SQL["nested_transactions"] = f"""SELECT site, "user", CAST((row_number() OVER (PARTITION BY site, "user" ORDER BY seq, item) - 1) // {NESTED_ITEMS} AS BIGINT) AS chunk,
  seq, "timestamp", item FROM ({ORACLE_SQL['build_transactions']})"""
ORACLE_SQL["apply_registered_spec"] = ORACLE_SQL["apply_field_spec"]
ORACLE_SQL["score_events_xml"] = ORACLE_SQL["score_events"]
ORACLE_SQL["build_purchase_set"] = ORACLE_SQL["purchase_preferences"]
ORACLE_SQL["read_orders_by_weight"] = ORACLE_SQL["read_orders_parquet"]
_CUT_TEXT = f"""concat_ws(',', site, CASE WHEN item % {BAD_EVERY} = 0 THEN 'x' ELSE CAST("timestamp" AS VARCHAR) END, "user", "group")"""
ORACLE_SQL["text_problems"] = f"""SELECT CASE WHEN item % {CUT_EVERY} = 0 THEN t ELSE t || ',' || item END AS value,
  CASE WHEN item % {CUT_EVERY} = 0 THEN 'expected 5 fields' ELSE 'field ' || chr(39) || 'timestamp' || chr(39) END AS problem
FROM (SELECT item, {_CUT_TEXT} AS t FROM ({ORACLE_SQL['read_orders_parquet']}))
WHERE item % {CUT_EVERY} = 0 OR item % {BAD_EVERY} = 0"""
ORACLE_SQL["read_events_json"] = ORACLE_SQL["read_events_parquet"]


def _in_common(part: int, sql: str, keys, numbers, value=None) -> str:
    texts = [f'CAST({c} AS VARCHAR) AS k{i}' for i, c in enumerate([*(f'"{k}"' for k in keys), "NULL", "NULL", "NULL"][:3], 1)]
    longs = [f'CAST({c} AS BIGINT) AS n{i}' for i, c in enumerate([*(f'"{n}"' for n in numbers), "NULL", "NULL"][:2], 1)]
    return f"""SELECT CAST({part} AS INTEGER) AS part, {', '.join(texts + longs)}, CAST({f'"{value}"' if value else 'NULL'} AS DOUBLE) AS value FROM ({sql})"""


ORACLE_SQL["build_engagement_set"] = " UNION ALL ".join(_in_common(part, ORACLE_SQL[name], *SET_COLUMNS[part]) for part, name in enumerate(
    ("engagement_ratings", "user_index", "item_index", "feature_matrix", "feature_rated_block"), 1))
# Document readers give the records they were made from.
for _name in ("events", "orders"):
    ORACLE_SQL[f"read_{_name}_documents"] = ORACLE_SQL[f"read_{_name}_documents_map"] = ORACLE_SQL[f"read_{_name}_parquet"]
    ORACLE_SQL[f"read_{_name}_nested"] = ORACLE_SQL[f"read_{_name}_parquet"]
    ORACLE_SQL[f"read_{_name}_nested_explicit"] = ORACLE_SQL[f"read_{_name}_parquet_explicit"]
    ORACLE_SQL[f"read_{_name}_text"] = ORACLE_SQL[f"read_{_name}_parquet"]
    ORACLE_SQL[f"read_{_name}_text_explicit"] = ORACLE_SQL[f"read_{_name}_parquet_explicit"]
    ORACLE_SQL[f"read_{_name}_documents_explicit"] = ORACLE_SQL[f"read_{_name}_parquet_explicit"]
