"""Session helpers: a tuned local session and a durable way to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "labelscope") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small local tables are heavy on regular expressions: keep every core busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the session.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="labelscope-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def materialize(df: DataFrame, free: bool = False) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    The copy survives lost executors, and later stages that read it several
    times get column pruning instead of recomputing the plan behind it. With
    `free`, its shuffles go when it is written, not whenever the driver happens
    to collect its garbage, so a job of many stages holds the shuffles of one.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
