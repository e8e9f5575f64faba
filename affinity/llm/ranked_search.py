"""Ranked lexical search by presence masks: the best documents of every item of a query set.

Scores are integers: a term's weight (from the documents that hold it) times its
saturated frequency, summed over the item's different terms (``op12`` in the
README states the formula).

1. Items are taken in blocks of at most ``ITEM_BYTES`` of text, which bounds
   what is broadcast.  One pass over the documents keeps, per document, its
   length and its frequencies of the block's terms; these postings are stored.
2. Counts over all documents (documents, terms, documents per term) come from the
   stored postings by partial aggregates.
3. Every task reads its postings in groups of ``GROUP_DOCS`` documents and makes a
   bitmap per term.  For an item, the bitmaps of its terms, turned over, give each
   document's mask of matched terms.  Documents with one mask form a group whose
   scores are at most the sum, over the mask, of the largest contribution of each
   term.  Masks are evaluated by descending maximum; the item is finished when the
   next maximum is below its worst kept score (equal ones are still evaluated, as
   ties go to the smaller id).  The kept documents of an item are carried through
   all groups of a task.
4. The tasks' lists, at most ``best`` rows per item each, meet in two ranking steps.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.shared import read_documents, stored

#: Terms are runs of ASCII letters and digits and of all other alphabets; in UTF-8 these are bytes of their own.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BEST = 50
ITEM_BYTES = 1 << 20
GROUP_DOCS = 4096
#: Parts of an item's candidates in the first of the two ranking steps.
PARTS = 32


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, A-Z lower-cased; none for null."""
    return TERM.findall((text or "").encode().lower())


# ------------------------------------------------------------------ postings

def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with a term: its length and its counts of the numbered terms."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # of at most ITEM_BYTES of text

    def run(batches):
        number = shared.value
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if found:
                    held = Counter(map(number.get, found))
                    held.pop(None, None)
                    order = sorted(held)
                    ids.append(doc)
                    ns.append(len(found))
                    terms.append(order)
                    tfs.append([held[t] for t in order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights(held: DataFrame, count: int, documents: int) -> np.ndarray:
    """Weight of each numbered term, ``floor(1000 * ln((2N + 2) / (2df + 1)))``."""
    df = np.zeros(count, np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[r.t] = r.n  # one row per term of the block
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


# ------------------------------------------------------------------ masks

class Group:
    """Postings of some documents, term by term, with their contributions and bitmaps."""

    def __init__(self, table: pa.RecordBatch, weight: np.ndarray, documents: int, length: int):
        doc = table.column("doc_id")
        self.null = np.asarray(doc.is_null())
        self.doc = doc.fill_null(0).to_numpy()
        self.size = len(self.doc)
        lists = table.column("terms")
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tfs").flatten().to_numpy()
        at = np.repeat(np.arange(self.size), lists.value_lengths().to_numpy())
        n = table.column("n").to_numpy()
        wide = n.astype(object) if 50 * int(n.max(initial=0)) * documents >= 1 << 63 else n
        m = 50 + (50 * wide * documents // length).astype(np.int64)
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
        self.keys = term * self.size + at
        order = np.argsort(self.keys)
        self.keys, self.gain, term, at = self.keys[order], gain[order], term[order], at[order]
        self.term, first = np.unique(term, return_index=True)
        self.most = np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
        self.bits = np.zeros((len(first), -(-self.size // 8)), np.uint8)
        for lo in range(0, len(first), 512):  # terms whose plain rows stand in memory together
            a, b = first[lo], first[lo + 512] if lo + 512 < len(first) else len(term)
            plain = np.zeros((min(512, len(first) - lo), self.size), bool)
            plain[row[a:b] - lo, at[a:b]] = True
            self.bits[lo:lo + 512] = np.packbits(plain, axis=1)

    def masks(self, terms: np.ndarray):
        """Matched terms, distinct masks (bits per matched term), documents by mask and the bounds of each mask's documents."""
        row = np.searchsorted(self.term, terms)
        row = row[(row < len(self.term)) & (self.term[np.minimum(row, len(self.term) - 1)] == terms)] if len(self.term) else row[:0]
        if not len(row):
            return None
        any_bits = np.bitwise_or.reduce(self.bits[row], axis=0)
        docs = np.flatnonzero(np.unpackbits(any_bits, count=self.size))
        held = np.unpackbits(self.bits[row], axis=1, count=self.size)[:, docs]
        packed = np.packbits(held, axis=0)
        wide = np.zeros((len(docs), -(-len(packed) // 8) * 8), np.uint8)
        wide[:, :len(packed)] = packed.T
        words = wide.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
        words = words[order]
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
        return row, held[:, order[first]].T, docs[order], np.append(first, len(order))

    def scores(self, row: np.ndarray, mask: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents, given each one's mask over the matched terms ``row``."""
        which, bit = np.nonzero(mask)
        gain = self.gain[np.searchsorted(self.keys, self.term[row[bit]] * self.size + docs[which])]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, which, gain)
        return out


class Kept:
    """The best documents of one item so far: score, id and whether the id is null, best first."""

    def __init__(self, best: int):
        self.best = best
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """Scores below it are of no use."""
        return int(self.score[-1]) if len(self.score) == self.best else 1

    def add(self, score, doc, null):
        use = score >= self.floor
        score, doc, null = (np.concatenate(x) for x in ((self.score, score[use]), (self.doc, doc[use]), (self.null, null[use])))
        order = np.lexsort((doc, ~null, -score))[:self.best]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def evaluate(group: Group, terms: np.ndarray, kept: Kept) -> int:
    """Add a group's documents to an item's best; returns how many documents were scored."""
    found = group.masks(terms)
    if found is None:
        return 0
    row, masks, docs, bounds = found
    most = masks.astype(np.int64) @ group.most[row]
    order = np.argsort(-most, kind="stable")
    at, step, scored = 0, 64, 0
    while at < len(order) and most[order[at]] >= kept.floor:
        now = order[at:at + step]
        now = now[most[now] >= kept.floor]
        sizes = bounds[now + 1] - bounds[now]
        some = docs[np.repeat(bounds[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        kept.add(group.scores(row, np.repeat(masks[now], sizes, axis=0), some), group.doc[some], group.null[some])
        scored += len(some)
        at, step = at + step, 2 * step
    return scored


def best_of_tasks(held: DataFrame, items: list[np.ndarray], weight: np.ndarray, documents: int, length: int, best: int) -> DataFrame:
    """``(item, doc_id, score)``: every task's best documents of every item (numbered by place in ``items``)."""
    shared = held.sparkSession.sparkContext.broadcast((items, weight))  # of at most ITEM_BYTES of text

    def run(batches):
        items, weight = shared.value
        kept = [Kept(best) for _ in items]
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_DOCS):
                group = Group(batch.slice(at, GROUP_DOCS), weight, documents, length)
                for terms, one in zip(items, kept, strict=True):
                    evaluate(group, terms, one)
        for k, one in enumerate(kept):
            if len(one.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(one.score), k, np.int32)), pa.array(one.doc, pa.int64(), mask=one.null), pa.array(one.score)],
                    names=["item", "doc_id", "score"])

    return held.mapInArrow(run, "item int, doc_id long, score long")


# ------------------------------------------------------------------ search

def _ranked(rows: DataFrame, keys: list[str], best: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _search(docs: DataFrame, texts: list, best: int) -> DataFrame:
    """``(key, rank, doc_id, score)`` for one block of (key, text) items."""
    spark = docs.sparkSession
    found = [sorted(set(terms_of(text))) for _, text in texts]
    numbers = {t: k for k, t in enumerate(sorted({t for one in found for t in one}))}
    held = stored(postings(docs, numbers), "postings")
    documents, length = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    names = spark.createDataFrame([(k, key) for k, (key, _) in enumerate(texts)], "item int, key string")
    if not documents:
        return names.select("key", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    weight = weights(held, len(numbers), documents)
    items = [np.array([numbers[t] for t in one], np.int64) for one in found]
    rows = best_of_tasks(held, items, weight, documents, length, best)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    rows = _ranked(_ranked(rows, ["item", "part"], best), ["item"], best)
    return rows.join(F.broadcast(names), "item").select("key", "rank", "doc_id", "score")  # one row per item of the block


def _blocks(items: DataFrame, size: int):
    """Lists of (key, text) of different texts, of at most ``size`` bytes each (a longer text is alone)."""
    block, held = [], 0
    for r in items.dropDuplicates(["key"]).select("key", "text").toLocalIterator():
        used = len((r.text or "").encode())
        if block and held + used > size:
            yield block
            block, held = [], 0
        block.append((r.key, r.text))
        held += used
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", best: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents with a score above 0 of every row of ``items``.

    Equal scores rank by ascending id, a null id first; repeated documents are
    ranked each.  A null text has no terms.  Items with equal texts share one
    search and are answered each, null item ids included; an item without terms,
    or without a document that holds one, gives no row.  Empty tables give no
    rows.  Other columns are not read.
    """
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null")
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).withColumn(
        "key", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = None
    for block in _blocks(asked, item_bytes):
        part = _search(wanted, block, best)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return asked.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir):
    """Contract query: item_id, rank, doc_id, score of every benchmark item's 50 best documents."""
    return ranked_search(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT rid, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS len FROM lengths),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) GROUP BY rid, term),
wanted AS (SELECT DISTINCT iid, item_id, term FROM (
  SELECT iid, item_id, unnest(terms) AS term FROM (
    SELECT row_number() OVER () AS iid, item_id, {_SQL_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL))),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM wanted) GROUP BY term), total),
scores AS (SELECT iid, item_id, rid, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // len)))) AS BIGINT) AS score
  FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN lengths USING (rid), total
  GROUP BY iid, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= {BEST}
"""
