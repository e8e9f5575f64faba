"""Session helpers: a local session for tests and benchmarks, and checkpoint
directory handling.

Library code never creates a session; it takes the session of the DataFrames it
is given.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session;
only ``local_session`` chooses a folder itself, where none is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "affinity") -> SparkSession:
    """Session for tests and benchmarks (local mode, UI off, UTC, AQE on).

    Where no ``spark.checkpoint.dir`` is configured it gets a scratch folder.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("AFFINITY_DRIVER_MEMORY", "4g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    return with_local_checkpoints(spark)


def with_local_checkpoints(spark: SparkSession) -> SparkSession:
    """Give a session on one machine (master ``local``) a scratch checkpoint folder if it has none; others are left as they are."""
    sc = spark.sparkContext
    one_machine = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if one_machine and not sc.getCheckpointDir() and not sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="affinity-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint directory of the session's SparkContext.

    An already active directory, else the one ``spark.checkpoint.dir`` names; on
    a cluster that must be a folder all executors share.  Without either this
    raises, on any master.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        if not spark.conf.get("spark.checkpoint.dir", None):
            raise RuntimeError("spark.checkpoint.dir is not set on the server") from None
        return spark.conf.get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder (HDFS, object store) "
            "so checkpoints survive the loss of an executor"
        )
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
