"""What several operators of this package need: stored tables, text rules, components."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.plans.materialize import materialize
from affinity.session import checkpoint_dir

#: The byte values that separate words (fixed values of the contracts): space, tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column):
    """Lower-case A-Z and nothing else (``lower`` would change other alphabets too)."""
    return F.translate(column, UPPER, UPPER.lower())


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(batches, rows: int = 256):
    """The rows of Arrow batches in smaller ones, so that a Python worker holds few texts as objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: later passes read the files, which every executor sees and
    which survive lost executors.  Schema and rows are those of ``df``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, label: str, buckets: int, keys: list[str]) -> tuple[DataFrame, str]:
    """Write ``df`` once in the shared checkpoint folder, bucketed and sorted by ``keys``.

    Returns the table, whose joins and groups by ``keys`` need no shuffle of its
    rows, and the folder of its files.  The name it needs while it is written is
    taken off the catalog again; the files stay.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table, path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a job leave the disk when its result is written, not when the driver collects its garbage.

    For jobs of one action each; a table that is used again is stored.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drop_folder(spark: SparkSession, name: str) -> None:
    """Delete a folder of stored tables (``stored(df, f"{name}/label")``), if there is one, that no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of the undirected ``edges``: one row ``(node, root)`` per node.

    ``root`` is the smallest node of the component.  Alternates large-star and
    small-star steps (join and minimum per node, so a hub with any number of
    links is pre-aggregated before its shuffle); each round is checkpointed and
    only a row count and a checksum reach the driver.  Nodes without links to
    other nodes do not occur in the result.
    """
    work = materialize(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
                       .where("u <> v").distinct())
    seen = _checksum(work)
    while seen[0]:
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        work = materialize(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _checksum(work)
        if now == seen:
            break
        seen = now
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return work.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
