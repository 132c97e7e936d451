"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "pitpanel", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because there driver and executors are one machine.
    """
    configured = _configured(spark)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="pitpanel-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make reliable checkpoints possible, keeping a folder the session already names."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = shared_folder(spark)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so reruns cannot mix."""
    return f"{shared_folder(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str, mb: int = 24) -> DataFrame:
    """Rows dealt by ``keys``, a partition for about every ``mb`` of the files they come from, so that one fits a task's memory.

    The session's own number of partitions holds where that is larger, or where a source does not know its size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    n = sum(sizes) // (mb << 20) if max(sizes, default=0) < 2 ** 63 - 1 else 0
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder once and go on from there.

    For results that several branches read: Spark would otherwise compute them once per branch.
    The files survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
