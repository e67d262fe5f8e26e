"""Session helpers: how the library starts Spark, where it cuts lineage, and when it may broadcast."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "umbra") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("UMBRA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; set a temporary one only in local mode (tests), which ends with the process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir", "")
        if not configured:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="umbra-checkpoint-")
            atexit.register(shutil.rmtree, configured, True)
        sc.setCheckpointDir(configured)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, for tables that a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_folder() gave, or one in it, from whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, light: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there (survives lost executors).

    A checkpointed frame keeps the size that Spark had estimated for its plan, in which each join multiplies its inputs'.
    In loops that number itself grows without bound and fills the driver, so the frame is made anew from what was written.
    light: for frames of a few numbers a row; they are written as no more files than the cluster has cores, as on local disks
    each file that is made starts a process beside the executor.
    """
    spark = df.sparkSession
    if light:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    written = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def let_go(df: DataFrame, rounds: int = 3) -> None:
    """Shuffle files and checkpoints that nothing refers to any more go now, not when the driver happens to collect its garbage.

    What one round finds dead still holds others, which the next one finds.
    """
    for _ in range(rounds):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if a count proves that it has max_rows rows at most, else df for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
