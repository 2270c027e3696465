"""JSON and CSV sinks of scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import text as T

CSV_COLUMNS = [
    "Record Type", "Inspection ID", "Product Name", "Commodity Type", "Overall Status",
    "Compliance Score", "Field", "Rule ID", "Status / Severity", "Detected Text / Value",
    "Surface Index", "Bounding Box Coordinates", "Finding / Reason", "Confidence",
]


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def _or_na(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.when(text != "", text), F.lit("N/A"))


def _box(box: Column) -> Column:
    """[a; b; c; d], whole numbers without a fraction."""
    parts = F.transform(box, lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))
    return F.when(box.isNotNull(), F.concat(F.lit("["), F.array_join(parts, "; "), F.lit("]"))).otherwise("N/A")


def csv_findings(results: DataFrame) -> DataFrame:
    """Fourteen text columns: a row per violation, then one per declaration."""
    c = F.col
    head = ["scan_id", "product", "overall_status", "score"]

    def common() -> list[Column]:
        return [
            c("scan_id").cast("string").alias("Inspection ID"), _or_na(c("product.name")).alias("Product Name"),
            _or_na(c("product.type")).alias("Commodity Type"), c("overall_status").alias("Overall Status"),
            c("score").cast("string").alias("Compliance Score")]

    v = results.select(*head, F.explode("violations").alias("v")).select(
        F.lit("VIOLATION").alias("Record Type"), *common(), T.field_label(c("v.field")).alias("Field"),
        _or_na(c("v.rule_id")).alias("Rule ID"), c("v.status").alias("Status / Severity"),
        _or_na(c("v.evidence.value")).alias("Detected Text / Value"),
        F.coalesce(c("v.evidence.image_index"), F.lit(1)).cast("string").alias("Surface Index"),
        _box(c("v.evidence.bbox")).alias("Bounding Box Coordinates"), c("v.reason").alias("Finding / Reason"),
        F.lit("N/A").alias("Confidence"))
    percent = F.concat(F.floor(c("d.confidence") * 100 + 0.5).cast("string"), F.lit("%"))
    d = results.select(*head, F.explode("declarations").alias("d")).select(
        F.lit("DECLARATION").alias("Record Type"), *common(), T.field_label(c("d.field")).alias("Field"),
        F.lit("N/A").alias("Rule ID"), F.lit("COMPLIANT").alias("Status / Severity"),
        c("d.value").alias("Detected Text / Value"),
        F.coalesce(c("d.image_index"), F.lit(1)).cast("string").alias("Surface Index"),
        _box(c("d.bbox")).alias("Bounding Box Coordinates"),
        F.lit("Statutory declaration verified").alias("Finding / Reason"),
        F.when(c("d.confidence") != 0, percent).otherwise("N/A").alias("Confidence"))
    return v.unionByName(d).select(*CSV_COLUMNS)


def write_csv(results: DataFrame, path: str) -> None:
    csv_findings(results).write.mode("overwrite").option("quoteAll", True).option(
        "escape", '"').option("header", True).csv(path)
