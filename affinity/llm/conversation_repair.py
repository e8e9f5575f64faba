"""Conversation structure repair: the cheapest edits that make a conversation well-formed.

A conversation is well-formed if its roles' initials read ``(s?(ua)+)?``.  Rows are
kept (0), given the role user or assistant (2) or deleted (3, required for blank
and duplicate rows); empty user or assistant rows may be inserted anywhere (2).  A
truncated row that is not deleted costs 1 more.  Among the cheapest edits the ones
whose initials ``K``, ``R``, ``D``, ``I`` read least in ASCII win: the *audit*.

The edit lattice has a node for every number of rows done and every state of the
grammar (nothing yet, after s, after u, after a).  Two Dijkstra searches run on it,
one from its start and one, against the arcs, from its ends.  They stop when their
next costs together exceed the cheapest path known, so that every path of that
cost crosses from nodes settled forwards to nodes settled backwards.  A node is
settled when all nodes that lead to it at its cost are, so it holds its least
audit; no audit of a node is the start of another one of the same cost (a loop of
insertions costs something), so the least joint of a least head, an arc and a
least tail is the least audit.

Conversations of any length:

1. Rows become codes without text (role, hash of the text, faults), combined
   before their shuffle if equal.  Duplicates are found by position within (conversation,
   role, text) over range partitions, which split a hot group.
2. Codes are range-partitioned in conversation order.  A conversation inside
   one partition is repaired there.  One that lies at a partition's edge, or is longer
   than ``SEGMENT`` rows, is cut into segments; each gives the cheapest edits from every
   state to every state, and the segments of a conversation are chained.
3. Texts are sorted by conversation behind its audit and walked through once, row
   by row; a digest of a whole conversation is made from its rows in order.

What remains in one task is a conversation's audit and its digest, which are one
value each in the result; texts are never held together.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.shared import BLANKS, stored
from affinity.plans.sequence import group_position

#: Rows of a segment.
SEGMENT = 1024
#: States of the grammar.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (NOTHING, AFTER_S, AFTER_U, AFTER_A)
ENDS = (NOTHING, AFTER_A)
#: Faults of a row; the first one counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
#: Costs of the edits (fixed values of the contract).
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1


# ------------------------------------------------------------------ the lattice

def following(state: int) -> int:
    """State after a user or assistant row that fits."""
    return AFTER_A if state == AFTER_U else AFTER_U


def kept_state(state: int, initial: str) -> int | None:
    """State after keeping a row of that initial; none if it does not fit."""
    if initial == "s":
        return AFTER_S if state == NOTHING else None
    if initial == ("a" if state == AFTER_U else "u"):
        return following(state)
    return None


class Lattice:
    """Rows as (initial, fault), with the arcs from and to every node."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows

    def out(self, node):
        """Arcs ``(node, cost, letter)`` from a node."""
        at, state = node
        yield (at, following(state)), INSERT, "I"
        if at < len(self.rows):
            initial, fault = self.rows[at]
            yield (at + 1, state), DELETE, "D"
            if fault not in (BLANK, DUPLICATE):
                more = CUT_OFF if fault == TRUNCATED else 0
                yield (at + 1, following(state)), REROLE + more, "R"
                kept = kept_state(state, initial)
                if kept is not None:
                    yield (at + 1, kept), more, "K"

    def into(self, node):
        """Arcs ``(node, cost, letter)`` that lead to a node."""
        at, state = node
        for before in STATES:
            for row in (at, at - 1):
                if row >= 0:
                    for to, cost, letter in self.out((row, before)):
                        if to == node:
                            yield (row, before), cost, letter


def cheapest(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str]:
    """Least cost and least audit from ``start`` before the rows to one of ``ends`` after them; cost -1 if there is no way."""
    lattice = Lattice(rows)
    cost, audit = ({(0, start): 0}, {(len(rows), e): 0 for e in ends}), ({(0, start): ""}, {(len(rows), e): "" for e in ends})
    settled = (set(), set())
    # order of settling: cost, then along the rows, so that all equal-cost ways to a node come before it
    heaps = ([(0, 0, start)], [(0, 0, e) for e in ends])
    heapq.heapify(heaps[1])
    best = min((c + cost[1][n] for n, c in cost[0].items() if n in cost[1]), default=None)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(len(settled[1]) < len(settled[0]))
        value, done, state = heapq.heappop(heaps[side])
        node = (len(rows) - done if side else done, state)
        if node in settled[side]:
            continue
        settled[side].add(node)
        own, held = audit[side][node], cost[side]
        for other, more, letter in (lattice.into if side else lattice.out)(node):
            total, text = value + more, letter + own if side else own + letter
            if other not in held or total < held[other]:
                held[other], audit[side][other] = total, text
                heapq.heappush(heaps[side], (total, len(rows) - other[0] if side else other[0], other[1]))
                if other in cost[1 - side] and (best is None or total + cost[1 - side][other] < best):
                    best = total + cost[1 - side][other]
            elif total == held[other] and text < audit[side][other]:
                audit[side][other] = text
    if best is None:
        return -1, ""
    crossings = []
    for node in settled[0]:
        if node in settled[1] and cost[0][node] + cost[1][node] == best:
            crossings.append(audit[0][node] + audit[1][node])
        if node[0] == len(rows) and node[1] in ends and cost[0][node] == best:
            crossings.append(audit[0][node])
        for other, more, letter in lattice.out(node):
            if (other in settled[1] or other[0] == len(rows) and other[1] in ends) and cost[0][node] + more + cost[1][other] == best:
                crossings.append(audit[0][node] + letter + audit[1][other])
    if (0, start) in settled[1] and cost[1][0, start] == best:
        crossings.append(audit[1][0, start])
    return best, min(crossings)


# ------------------------------------------------------------------ rows to codes

def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after the contract's damage by crc32 of ``conv_id:turn`` modulo 20.

    0: no copy is left; 1: the text is empty; 2: it loses its ``.!?``; 3: two copies; 4: the role is user.
    Null roles, texts, and ids and turns in the hashed string, count as one space.
    """
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(plain("role")).alias("role"),
        text.alias("text"), F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


def codes(rows: DataFrame) -> DataFrame:
    """Rows without their texts: ``(conv_id, turn, role, key, copies, fault, nth)``, equal rows combined.

    ``nth`` is 0 where no row of the conversation with the same role and text comes before.
    """
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", F.lit(BLANK)).when(~end.isin(".", "!", "?"), F.lit(TRUNCATED)).otherwise(F.lit(NONE))
    slim = rows.select("conv_id", "turn", "role", F.md5("text").alias("key"), "copies", fault.alias("fault"))
    # rows that are not there have no place in the order, but keep their conversation in the result
    gone = F.col("copies") == 0
    slim = slim.select("conv_id", *[F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "key", "fault")], "copies")
    joint = slim.groupBy("conv_id", "turn", "role", "key").agg(F.sum("copies").alias("copies"), F.max("fault").alias("fault"))
    return group_position(joint, ["conv_id", "role", "key"], ["turn"], "nth")


# ------------------------------------------------------------------ repairs

_COUNTS = ("n", "turns", "blank", "duplicate", "truncated", "illegal")
_SEGMENT = ("conv_id {kind}, whole boolean, task int, place int, n long, turns long, blank long, duplicate long, truncated long, illegal long, "
            "low long, high long, first_turn long, last_turn long, first string, last string, ways array<struct<start:int,end:int,cost:long,audit:string>>")


class Run:
    """Rows of one conversation that stand together, as they come in order."""

    def __init__(self, conv):
        self.conv, self.rows, self.turns = conv, [], []

    def add(self, turn, role, copies, fault, nth):
        for k in range(copies):
            again = fault != BLANK and (nth > 0 or k > 0)
            self.rows.append((role[:1], DUPLICATE if again else fault))
            self.turns.append(turn)

    def result(self, whole: bool, task: int, place: int) -> tuple:
        faults = [f for _, f in self.rows]
        known = [t for t in self.turns if t is not None]
        initials = [r for r, _ in self.rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        starts, ends = ((NOTHING,), (ENDS,)) if whole else (STATES, [(e,) for e in STATES])
        ways = [(s, e[0], *cheapest(self.rows, s, e)) for s in starts for e in ends]
        return (self.conv, whole, task, place, len(self.rows), len(set(known)), faults.count(BLANK), faults.count(DUPLICATE),
                faults.count(TRUNCATED), illegal, min(known, default=None), max(known, default=None),
                known[0] if known else None, known[-1] if known else None, initials[0] if initials else None,
                initials[-1] if initials else None, [w for w in ways if w[2] >= 0])


def _segments(ordered: DataFrame, segment: int) -> DataFrame:
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = _SEGMENT.format(kind=kind)

    def run(batches):
        from pyspark import TaskContext

        task, place, current, edge = TaskContext.get().partitionId(), 0, None, True
        done = []
        for batch in batches:
            for conv, turn, role, copies, fault, nth in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "copies", "fault", "nth")), strict=True):
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.result(not edge, task, place))
                        place, edge = place + 1, False
                    current = Run(conv)
                for left in range(0, copies, segment):  # (a row may stand for many equal ones)
                    if len(current.rows) >= segment:  # the rest of it is a segment of its own
                        done.append(current.result(False, task, place))
                        place, edge, current = place + 1, True, Run(conv)
                    current.add(turn, role, min(segment, copies - left), fault, nth if not left else 1)
            if done:
                yield _table(done, batch.schema.field("conv_id").type)
                done = []
        if current is not None:  # it may go on in the next partition
            yield _table([current.result(False, task, place)], batch.schema.field("conv_id").type)

    return ordered.mapInArrow(run, schema)


_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _table(rows: list[tuple], conv_type) -> pa.RecordBatch:
    kinds = [conv_type, pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 10, pa.string(), pa.string(), _WAYS]
    names = [c.split()[0] for c in _SEGMENT.split("array")[0].replace("{kind}", "x").split(", ")]
    columns = [pa.array(c if t != _WAYS else [[dict(zip(("start", "end", "cost", "audit"), w, strict=True)) for w in one] for one in c], t)
               for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _chained(table: pa.Table) -> pa.Table:
    """One row for the segments of one conversation, in order."""
    parts = sorted((r for r in table.to_pylist()), key=lambda r: (r["task"], r["place"]))
    reached = {NOTHING: (0, "")}
    out = {c: 0 for c in _COUNTS}
    low = high = last = before = None
    for part in parts:
        now: dict = {}
        for way in part["ways"]:
            if way["start"] in reached:
                cost, audit = reached[way["start"]]
                label = (cost + way["cost"], audit + way["audit"])
                now[way["end"]] = min(now.get(way["end"], label), label)
        reached = now
        for c in _COUNTS:
            out[c] += part[c]
        if part["n"]:
            out["illegal"] += last is not None and last + part["first"] not in LEGAL
            last = part["last"]
        if part["low"] is not None:
            out["turns"] -= before == part["first_turn"]
            before = part["last_turn"]
            low, high = part["low"] if low is None else low, part["high"]
    cost, audit = min(reached[e] for e in ENDS if e in reached)
    gaps = high - low + 1 - out["turns"] if low is not None else 0
    return pa.table({"conv_id": table["conv_id"][:1], "gaps": [gaps], **{c: [int(out[c])] for c in _COUNTS[2:]}, "cost": [cost], "audit": [audit]})


def repairs(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per conversation of ``rows``.

    ``rows`` are ``(conv_id, turn, role, text, copies)``; a row with 0 copies is not
    there.  Rows count by turn, nulls first; rows with one turn by role, then by
    the hash of their text.  A null conv_id is a conversation of its own.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "key"]
    ordered = codes(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(_segments(ordered, segment), "segments")
    way = F.col("ways")[0]
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = found.where("whole").select("conv_id", gaps.cast("long").alias("gaps"), *_COUNTS[2:], way["cost"].alias("cost"), way["audit"].alias("audit"))
    cut = found.where("not whole").groupBy("conv_id").applyInArrow(
        _chained, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return whole.unionByName(cut)


# ------------------------------------------------------------------ the repaired rows

class Walk:
    """Applies an audit to the rows of its conversation as they come; gives what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _letter(self):
        letter, self.at = self.audit[self.at:self.at + 1], self.at + 1
        return letter

    def _fitting(self) -> str:
        self.state = following(self.state)
        return "assistant" if self.state == AFTER_A else "user"

    def inserted(self):
        """Roles of the rows inserted here."""
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._fitting()

    def kept(self, role: str) -> str | None:
        """Role of a row after its edit, or none if it is deleted."""
        letter = self._letter()
        if letter == "D":
            return None
        if letter == "R":
            return self._fitting()
        self.state = kept_state(self.state, role[:1])
        return role


def _walked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit row, then its rows in order."""
    results = F.struct(*[c for c in found.columns if c != "conv_id"])
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("long").alias("copies"),
                         results.alias("found"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("key"), "text", "copies",
                                           F.lit(None).cast(heads.schema["found"].dataType).alias("found"))
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key")


def _walk(batches, start, emit, finish):
    """Drive the callbacks over the ordered rows; ``start(conv, found)`` makes a conversation's state."""
    walk = held = None

    def end():
        if walk is not None:
            for role in walk.inserted():
                emit(held, role, "")
            finish(held)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for conv, kind, role, text, copies, found in zip(*(part.column(c).to_pylist() for c in (
                    "conv_id", "kind", "role", "text", "copies", "found")), strict=True):
                if kind == 0:
                    end()
                    walk, held = Walk(found["audit"]), start(conv, found)
                    continue
                for _ in range(copies):
                    for own in walk.inserted():
                        emit(held, own, "")
                    own = walk.kept(role)
                    if own is not None:
                        emit(held, own, text)
            yield
    end()
    yield


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)``: the rows of every conversation after its repair, in order from 0."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out = []

        def emit(held, role, text):
            out.append((held[0], held[1], role, text))
            held[1] += 1

        for _ in _walk(batches, lambda conv, _: [conv, 0], emit, lambda held: None):
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "place", "role", "text"), r, strict=True)) for r in out], schema=pa.schema(
                    [("conv_id", arrow), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
                out.clear()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    return _walked(rows, found).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def repair_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``: the digest of the repaired ``role:text``, joined by line ends."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, names = rows.schema["conv_id"].dataType.simpleString(), [c for c in found.columns if c != "conv_id"]
    types = [to_arrow_type(found.schema[c].dataType) for c in found.columns]

    def run(batches):
        out = []

        def emit(held, role, text):
            held[2].update(f"{held[3]}{role}:{text}".encode())
            held[3] = "\n"

        for _ in _walk(batches, lambda conv, result: [conv, result, hashlib.sha256(), ""], emit,
                       lambda held: out.append((held[0], *(held[1][c] for c in names), held[2].hexdigest()))):
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*types, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *names, "repaired_sha256"])
                out.clear()

    fields = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in names)
    return _walked(rows, found).mapInArrow(run, f"conv_id {kind}, {fields}, repaired_sha256 string")


def op13_conversation_repair(spark, sf_dir):
    """Contract query: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_digests(rows, repairs(rows))


_SQL_STEP = """SELECT conv_id, i + 1 AS i, st, min({{'cost': cost, 'audit': audit, 'out': out}}) AS best
  FROM (
    SELECT c.conv_id, c.i, e.st, c.cost + e.cost AS cost, c.audit || e.letter AS audit,
           c.out || CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [c.role || ':' || c.text]
                    ELSE [CASE WHEN e.st = 2 THEN 'user:' ELSE 'assistant:' END || c.text] END AS out
    FROM (SELECT s.conv_id, s.i, x.st, s.best.cost + x.cost AS cost, s.best.audit || x.audit AS audit, s.best.out || x.out AS out,
                 r.role, r.text, r.initial, r.fault
          FROM lattice s JOIN inserts x ON s.st = x.was JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i) c,
    LATERAL (SELECT c.st AS st, 3 AS cost, 'D' AS letter
             UNION ALL SELECT CASE WHEN c.st = 2 THEN 3 ELSE 2 END, 2 + CAST(c.fault = 3 AS INTEGER), 'R' WHERE c.fault NOT IN (1, 2)
             UNION ALL SELECT CASE c.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CAST(c.fault = 3 AS INTEGER), 'K'
             WHERE c.fault NOT IN (1, 2) AND (c.initial = 's' AND c.st = 0 OR c.initial = 'u' AND c.st <> 2 OR c.initial = 'a' AND c.st = 2)) e)
  GROUP BY conv_id, i, st"""

_SQL_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
hashed AS (
  SELECT *, row_number() OVER () AS rid, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, rid, unnest(CASE kind WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 3 THEN [0, 1] ELSE [0] END) AS copy,
         CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM hashed),
placed AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, {_SQL_BLANKS}) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), rid, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS nth
  FROM damaged),
numbered AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
inserts AS (
  SELECT * FROM (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])) AS t(was, st, cost, audit, out)),
lattice AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS i, 0 AS st, {{'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])}} AS best FROM conversations
  UNION ALL
  {_SQL_STEP.replace("{{", "{").replace("}}", "}")}),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM numbered GROUP BY conv_id),
ended AS (
  SELECT l.conv_id, min({{'cost': l.best.cost + x.cost, 'audit': l.best.audit || x.audit, 'out': l.best.out || x.out}}) AS best
  FROM lattice l LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id JOIN inserts x ON l.st = x.was
  WHERE l.i = coalesce(c.n, 0) + 1 AND x.st IN (0, 3) GROUP BY l.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit,
       sha256(array_to_string(e.best.out, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
