"""History kept up to date from a stream of scan results.

A stream only drives the batch code. Items are dealt into BUCKETS by a hash of
their id, and a micro-batch reads and rewrites the buckets it touches, nothing
else. A bucket has two slots, one of which is live: the new content goes into
the other one, over what expired there a change ago. A map of live slots, one
small file for each batch, publishes the batch; the last MAPS of them are kept.
A batch that runs again starts from the map before it, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.operators.history import COLUMNS, upsert

BUCKETS = 256
MAPS = 8
MAP = "batch long, bucket int, slot int"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _live(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """Live slot of every bucket in the latest map, or the latest one before a batch: at most BUCKETS entries."""
    try:
        maps = spark.read.schema(MAP).parquet(f"{root}/maps/turn=*")
        if before is not None:
            maps = maps.filter(F.col("batch") < before)
        latest = maps.groupBy("batch").agg(F.collect_list(F.struct("bucket", "slot")).alias("m")).orderBy(F.desc("batch")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.bucket: r.slot for r in latest.m} if latest else {}


def _items(spark: SparkSession, root: str, slots: dict[int, int]) -> DataFrame:
    """Items of the given buckets; both conditions are on folders, so other slots aren't read."""
    of = [[b for b, s in slots.items() if s == slot] for slot in (0, 1)]
    read = spark.read.parquet(f"{root}/items")
    return read.filter((F.col("slot") == 0) & F.col("bucket").isin(of[0]) | (F.col("slot") == 1) & F.col("bucket").isin(of[1]))


def read_history(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The history as last published, or as it was before a batch among the last two that touched it."""
    slots = _live(spark, root, before)
    return _items(spark, root, slots).select(*COLUMNS) if slots else None


def upsert_batch(root: str, buckets: int = BUCKETS):
    """foreachBatch function that upserts a batch into the buckets it touches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*COLUMNS).persist()
        touched = [r.b for r in new.select(_bucket(buckets).alias("b")).distinct().collect()]  # `buckets` at most
        live = _live(spark, root, before=batch_id)
        known = {b: live[b] for b in touched if b in live}
        existing = _items(spark, root, known).select(*COLUMNS) if known else new.limit(0)
        slots = {b: 1 - live.get(b, 1) for b in touched}
        if touched:
            slot = F.element_at(F.create_map(*[F.lit(x) for pair in slots.items() for x in pair]), F.col("bucket"))
            (upsert(existing, new).withColumn("bucket", _bucket(buckets)).withColumn("slot", slot)
             .repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("slot", "bucket").parquet(f"{root}/items"))
        rows = [(batch_id, b, s) for b, s in (live | slots).items()]
        spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{root}/maps/turn={batch_id % MAPS}")
        new.unpersist()

    return write


def stream_history(items: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """Start the upsert of a streaming DataFrame of history items."""
    writer = items.writeStream.foreachBatch(upsert_batch(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_items(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Stream of history items dropped as JSON files into a folder."""
    return spark.readStream.schema(schema).json(folder).withColumn(
        "is_demo", F.coalesce("is_demo", F.lit(False)))
