"""Inspection history: items from results, upsert, union, search and sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.operators.analytics import half_up
from labelscope.session import materialize

COLUMNS = ["id", "name", "category", "status", "score", "raw_date", "violations_count",
           "declarations_count", "mean_confidence", "is_demo"]


def history_items(results: DataFrame, loaded_at) -> DataFrame:
    """Scan results as history items, dated when they were loaded."""
    confidences = F.transform(
        "declarations",
        lambda d: F.coalesce(F.when(d["confidence"] != 0, d["confidence"]), F.lit(0.9)))
    n = F.size("declarations")
    mean = half_up(F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / n, 100)
    return results.select(
        F.col("scan_id").cast("string").alias("id"),
        F.coalesce(F.nullif(F.col("product.name"), F.lit("")), F.lit("Packaged Commodity")).alias("name"),
        F.coalesce(F.nullif(F.col("product.type"), F.lit("")), F.lit("Packaged Goods")).alias("category"),
        F.col("overall_status").alias("status"), F.col("score").cast("double").alias("score"),
        loaded_at.cast("timestamp").alias("raw_date"), F.size("violations").alias("violations_count"),
        n.alias("declarations_count"), F.when(n > 0, mean).otherwise(0.92).alias("mean_confidence"),
        F.lit(False).alias("is_demo"))


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Newest live item per id; demo items are never persisted.

    max_by combines before the shuffle, so a hot id costs one row per task.
    """
    both = existing.filter(~F.col("is_demo")).select(*COLUMNS, F.lit(0).alias("age")).unionByName(
        new.select(*COLUMNS, F.lit(1).alias("age")))
    item = F.struct(*COLUMNS)
    return both.groupBy("id").agg(
        F.max_by(item, F.struct("age", "raw_date", item)).alias("i")).select("i.*")


def load(live: DataFrame, demo: DataFrame) -> DataFrame:
    """Live items first, then demo items (`source_rank`)."""
    return live.filter(~F.col("is_demo")).select(*COLUMNS, F.lit(0).alias("source_rank")).unionByName(
        demo.select(*COLUMNS, F.lit(1).alias("source_rank")))


def search(history: DataFrame, text: str = "", status: str = "ALL", source: str = "ALL") -> DataFrame:
    hit = F.lit(True)
    if status != "ALL":
        hit = hit & (F.col("status") == status)
    if source != "ALL":
        hit = hit & (F.col("is_demo") == F.lit(source == "DEMO"))
    query = text.lower().strip()
    if query:
        named = F.lit(False)
        for c in ("name", "id", "category"):
            named = named | F.contains(F.lower(c), F.lit(query))
        hit = hit & named
    return history.filter(hit)


SORTS = {
    "date-desc": F.desc, "date-asc": F.asc, "score-desc": F.desc, "score-asc": F.asc,
}


def sort(history: DataFrame, by: str = "date-desc", tie: str = "id") -> DataFrame:
    """Global order by date or score; the range shuffle splits on the tie as well."""
    column = "raw_date" if by.startswith("date") else "score"
    return history.orderBy(SORTS[by](column), tie)


def numbered(history: DataFrame, by: str = "date-desc", tie: str = "id") -> DataFrame:
    """The sorted history with each item's `place` from 1.

    Ranges of the global order are numbered on their own and moved on by the
    sizes of those before, so no task holds more than a range.
    """
    ranges = materialize(sort(history, by, tie).withColumn("_range", F.spark_partition_id()))
    column = "raw_date" if by.startswith("date") else "score"
    inside = Window.partitionBy("_range").orderBy(SORTS[by](column), tie)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    skipped = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    return ranges.withColumn("place", F.row_number().over(inside)).join(skipped, "_range").withColumn(
        "place", F.col("place") + F.col("_skip")).drop("_range", "_skip")
