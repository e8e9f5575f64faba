"""Random shards by a two-pass external shuffle.

Pass 1 scatters the rows uniformly into memory-sized buckets by a seeded hash.
Pass 2 reads one bucket at a time, puts it in a fixed order, shuffles it
(Fisher-Yates, seeded by bucket) and gives its rows consecutive positions after
those of the buckets before it (prefix sums of the buckets' sizes).  Position ``p`` goes to shard ``p mod n``, slot
``p div n``, so shard sizes differ by one row at most (the law ``rows``) and
slots have no gaps.  The buckets' sizes depend only on the hash, not on sources,
texts or lengths of groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.llm.shared import read_documents, stored
from affinity.plans.heavy import key_sketch, listed

LAW = "rows"
SHARDS = 8
SEED = 20240607
#: Text bytes a bucket should hold; one bucket is in a task's memory at a time.
BUCKET_BYTES = 24 << 20
#: Buckets whose sizes are summed together; and up to how many their starts are broadcast (16 bytes each).
GROUP, BROADCAST_BUCKETS = 1024, 500_000


def _size(text_col: str):
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")


def _measured(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[int, DataFrame | None]:
    """Number of buckets, and the (id, text) that stand on a large share of the rows, from one pass."""
    keyed = docs.select(_size(text_col).alias("s"), F.xxhash64(id_col, F.xxhash64(text_col)).alias("k"))
    seen = keyed.agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"), key_sketch(["k"]).alias("top")).first()
    repeated = [r for r in seen["top"] or () if r["count"] > 1]
    return max(1, math.ceil((seen["s"] or 0) / bucket_bytes)), listed(docs.sparkSession, repeated, seen["n"])


def _starts(keyed: DataFrame) -> DataFrame:
    """Rows in the buckets before each one: prefix sums inside groups of buckets, and of the groups."""
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("__bucket") / GROUP))
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"))  # a row per GROUP buckets
    before = groups.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("g").orderBy("__bucket")) - F.col("n")
    return counts.select("__bucket", "g", inside.alias("own")).join(before, "g").select(
        "__bucket", (F.col("own") + F.col("ahead")).cast("long").alias("__first"))


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
                    text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``__shard`` (int) and ``__slot`` (long).

    The order is a function of the ids, the texts and the seed.  Null ids and null
    or empty texts are rows like any other (size 1); rows equal in id and text each get a slot of
    their own, any of them the same one.  Where such rows are a thousandth of the table or
    more, they are scattered by their number as read, so no bucket holds them all; else they share a bucket.
    An empty table gives no rows.  Columns named ``__bucket``, ``__first``, ``__tie``, ``__shard`` or ``__slot`` are refused.
    """
    clash = {"__bucket", "__first", "__tie", "__shard", "__slot"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns with names of the operator: {sorted(clash)}")
    buckets, heavy = _measured(docs, id_col, text_col, bucket_bytes)
    key = F.xxhash64(id_col, F.xxhash64(text_col))
    if heavy is None:
        keyed = docs.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)))
    else:
        numbered = docs.withColumn("__tie", F.monotonically_increasing_id()).withColumn("__bucket", key)
        marked = numbered.join(F.broadcast(heavy.select(F.col("_key").alias("__first"))), F.xxhash64("__bucket") == F.col("__first"), "left")
        own = F.when(F.col("__first").isNotNull(), F.col("__tie")).otherwise(F.lit(0))
        keyed = marked.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__bucket", own), F.lit(buckets))).drop("__first", "__tie")
        keyed = stored(keyed, "scattered")  # numbers of rows must not change between the two uses
    starts = _starts(keyed)
    if buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    dealt = keyed.join(starts, "__bucket").withColumn("__tie", F.xxhash64(text_col))
    dealt = dealt.repartition("__bucket").sortWithinPartitions("__bucket", id_col, "__tie")
    fields = [f for f in dealt.schema.fields if f.name not in ("__bucket", "__first", "__tie")]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]
                          + [T.StructField("__shard", T.IntegerType()), T.StructField("__slot", T.LongType())])
    names = [f.name for f in fields]

    def run(batches):
        held, current = [], None
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("__bucket")).to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if current is not None and at[lo] != current:
                    yield from dealt_out(held, current)
                    held = []
                current = int(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from dealt_out(held, current)

    def dealt_out(held, current):
        table = pa.Table.from_batches(held)
        order = np.random.default_rng([seed, current]).permutation(table.num_rows)  # Fisher-Yates
        position = table["__first"][0].as_py() + np.arange(table.num_rows)
        out = table.take(pa.array(order)).select(names)
        out = out.append_column("__shard", pa.array(position % shards, pa.int32()))
        yield from out.append_column("__slot", pa.array(position // shards, pa.int64())).to_batches(max_chunksize=4096)

    return dealt.mapInArrow(run, schema)


def write_shards(docs: DataFrame, **options) -> DataFrame:
    """Write the shards to the shared folder, one directory per shard, and read them back."""
    return stored(shuffled_shards(docs, **options), "shards", partition_by="__shard")


def op3_sharding(spark, sf_dir):
    """Contract query: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    written = write_shards(read_documents(spark, sf_dir))
    return written.select(
        "doc_id", _size("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
