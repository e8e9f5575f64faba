"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

The history of lines is a set of *runs*: tables bucketed and sorted by line hash
that hold, per key, the number of documents and the largest doc_id.  A new batch
of documents is summed up per key and merge-anti-joined with the runs: keys that
no run has become the batch's own run, the others an update.  When a level has
``fan_out`` runs they are compacted into one run of the next level.  Since runs
are bucketed by the join key, a batch never makes the history shuffle again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.shared import BLANKS, ascii_lower, read_documents, stored, stored_in_buckets

KEY = ["k1", "k2"]
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_OUT = 2


class Run(NamedTuple):
    """A run: its table (bucketed and sorted by key) and the folder of its files."""

    table: DataFrame
    path: str


class LineRuns:
    """Levelled sorted runs ``(k1, k2, n, hi)``; every table is written once and never changed."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, buckets: int | None = None):
        # As many buckets as shuffles have partitions: sums and joins by key come out in buckets already.
        self.spark, self.fan_out = spark, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []
        self.updates: list[Run] = []

    def _run(self, rows: DataFrame) -> Run:
        return Run(*stored_in_buckets(rows, "line_run", self.buckets, KEY))

    def _rows(self, runs: list[Run]) -> DataFrame:
        # The files are read without their buckets here: a union of bucketed scans claims a
        # partitioning by key that its rows do not have, and would be aggregated wrongly.
        return self.spark.read.schema(runs[0].table.schema).parquet(*(run.path for run in runs))

    def add(self, keyed: DataFrame) -> None:
        """Add a batch of ``(k1, k2, doc_id)``; a document's lines must all come in one batch."""
        batch = self._run(keyed.select(*KEY, "doc_id").distinct().groupBy(*KEY)
                          .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("hi")))
        runs = [run for level in self.levels for run in level]
        if not runs:
            self.levels = [[batch]]
            return
        fresh = batch.table
        for run in runs:
            fresh = fresh.join(run.table.select(*KEY).hint("merge"), KEY, "left_anti")
        own = self._run(fresh)
        self.updates.append(self._run(batch.table.join(own.table.select(*KEY).hint("merge"), KEY, "left_anti")))
        self.levels[0].append(own)
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fan_out:
                merged = self._run(self._rows(self.levels[at]).repartition(self.buckets, *KEY))  # no key is in two runs
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)

    def totals(self) -> DataFrame:
        """``(k1, k2, n, hi)`` over everything added."""
        rows = self._rows([run for level in self.levels for run in level] + self.updates)
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("hi").alias("hi"))


def split_lines(text):
    """Lines of a text column; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, text_key, pos, k1, k2)`` of every line whose key has at least ``min_chars`` code points."""
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
        F.posexplode(split_lines(ascii_lower(F.col(text_col)))).alias("pos", "line"))
    key = F.trim("line", F.lit(BLANKS))
    return lines.select("doc_id", "text_key", "pos", key.alias("key")).where(F.char_length("key") >= min_chars) \
        .select("doc_id", "text_key", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT,
                  buckets: int | None = None) -> DataFrame:
    """``(doc_id, text_key, drops)``: positions of the lines that go, per document that loses any."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keyed = stored(line_keys(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines", partition_by="batch")
    runs = LineRuns(docs.sparkSession, fan_out, buckets)
    for k in range(batches):
        runs.add(keyed.where(F.col("batch") == k))
    common = stored(runs.totals().where(F.col("n") >= min_docs).select(*KEY, "hi"), "common")
    return keyed.join(common, KEY).where("doc_id <> hi").groupBy("doc_id", "text_key") \
        .agg(F.collect_list("pos").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, the text without dropped lines, plus ``__n_lines`` and ``__n_dropped`` (long).

    A line's key is the line stripped of ASCII blanks with A-Z lower-cased.  Keys
    of at least ``min_chars`` code points found in at least ``min_docs`` documents
    stay only in the largest doc_id that holds them (there, all their lines).
    Null and empty texts are one empty line and stay as they are.  Rows with a
    null id keep all lines and do not count; rows repeated with one id are one
    document.
    """
    drops = dropped_lines(docs, id_col, text_col, **options).withColumnsRenamed(
        {"doc_id": "__id", "text_key": "__key", "drops": "__drops"})
    own = docs.withColumns({"__own": F.col(id_col).cast("long"), "__own_key": F.xxhash64(text_col)})
    both = own.join(drops, (F.col("__own") == F.col("__id")) & (F.col("__own_key") == F.col("__key")), "left") \
        .withColumn("__lines", split_lines(F.col(text_col)))
    count = F.size("__lines")
    left = F.array_except(F.sequence(F.lit(0), count - 1), F.col("__drops"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    return both.withColumns({
        "__n_lines": count.cast("long"),
        "__n_dropped": F.coalesce(F.size(F.array_distinct("__drops")), F.lit(0)).cast("long"),
        text_col: F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(kept),
    }).drop("__own", "__own_key", "__id", "__key", "__drops", "__lines")


def op5_line_dedup(spark, sf_dir):
    """Contract query: doc_id, n_lines, n_dropped, kept_sha256."""
    result = dedup_lines(read_documents(spark, sf_dir))
    return result.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                         F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, line, pos,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key, max(doc_id) AS hi FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> c.hi, false) AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
