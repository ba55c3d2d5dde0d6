"""Session helpers.

The library never creates a session on its own; callers on a cluster pass
theirs.  ``local_session`` is what tests, the bench and the driver contract
use on a single machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    driver_memory: str = "8g",
    app_name: str = "reelspark",
) -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the SparkContext has a checkpoint directory.

    On a cluster the deployer names a shared folder in
    ``spark.checkpoint.dir``; it is read from the session and used as is.
    Only when nothing is configured (local runs, tests) a scratch folder is
    created under the system temp directory.
    """
    sc = spark_context(spark)
    if sc is None:  # Spark Connect: the server side owns checkpointing
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder for "
                "lineage cuts (a machine-local folder does not survive "
                "executor loss)"
            )
        configured = tempfile.mkdtemp(prefix="reelspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def spark_context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise on access
        return None


def app_key(spark: SparkSession) -> str:
    sc = spark_context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
