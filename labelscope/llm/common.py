"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import materialize, scratch_dir

__all__ = ["components", "materialize", "packed_table", "release", "scratch_dir", "small", "small_batches", "table"]

#: Rows an Arrow batch holds at most: a batch of very long texts stays below some 60 MB.
BATCH_ROWS = 512
#: A side of a join is broadcast only after a count has shown that it is no larger.
BROADCAST_ROWS = 500_000


def packed_table(df: DataFrame) -> DataFrame:
    """Like `materialize`, for large binary columns: written with zstd."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Keep the Arrow batches of this session short, since texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count shows that the table is small; joins give the same rows either way.

    For tables of narrow rows that are already written (the count is then a metadata read).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release() -> None:
    """Give memory that this Python worker has freed back to the system: Spark keeps idle workers."""
    import contextlib
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of an edge list (u, v) by alternating large and small stars.

    Returns (node, root) for every node that is not its own root; root is the
    smallest node of the component. Every round is written to the shared folder,
    so lineage stays short and a lost executor repeats one round only. Hubs are
    harmless: minima are combined before the shuffle, and the joins that carry
    them back can be split by adaptive execution.
    """
    edges = materialize(edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        starred = materialize(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = starred
        # done when no root is also a child and no child has two roots
        children = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = edges.select(F.col("v").alias("u")).distinct()
        open_ends = children.filter("n > 1").select("u").unionByName(
            roots.join(children, "u", "left_semi")).limit(1).count()
        if not open_ends:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
