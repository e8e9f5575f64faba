"""Lineage cuts through reliable checkpoints (never local ones)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from affinity.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint directory and read it back.

    Partitioning and in-partition order are kept, and later passes see the same
    rows in the same partitions even if executors are lost and tasks rerun.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, **seen: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once as Parquet in the checkpoint directory; the table, and aggregates of its rows.

    Smaller on disk than a checkpoint and pruned by column when it is read, but
    without the partitioning of ``df``.  The aggregates ``seen`` are observed in
    the tasks that write, so they cost no pass of their own.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    watch = Observation()
    df.observe(watch, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in seen.items())).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), watch.get
