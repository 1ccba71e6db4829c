"""Session helpers shared by the benchmark, the tests and the command scripts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", app: str = "somnotab") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SOMNOTAB_DRIVER_MEMORY", "8g"))
        # Call-site capture costs a millisecond per column expression, and plans here have many.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting falls back to a temporary folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="somnotab-")


def stage(frame: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    What several sinks read is computed once, and a lost executor only costs its own tasks.
    Partitions are rebalanced before they are written: small ones share a file, and one that
    holds most of the rows is split.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows = frame.hint("rebalance", *partition_by) if partition_by else frame
    rows.write.partitionBy(*partition_by).parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.staged_path = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete a staged table once nothing reads it any more; the frame itself, not one made from it."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
