"""Compliance analytics: global figures, daily trend, rankings and bands.

Everything groups by a small key, so counts combine on the map side and the
shuffle carries a few rows per task whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MISSING_CONFIDENCE = 0.92


def half_up(value: Column, scale: int = 1) -> Column:
    """Round half towards plus infinity to 1/scale."""
    return F.floor(value * scale + 0.5) / scale


def rate(part: Column, whole: Column, scale: int = 10) -> Column:
    """Percentage with one decimal (scale 10), 0 for an empty whole."""
    return F.coalesce(F.floor(F.try_divide(part * 100 * scale, whole) + 0.5) / scale, F.lit(0.0))


def _is(status: str) -> Column:
    return F.col("status") == status


def compliance_kpis(history: DataFrame) -> DataFrame:
    """Counts by status, compliance rate, violations and mean confidence."""
    conf = F.coalesce(F.when(F.col("mean_confidence") != 0, F.col("mean_confidence")), F.lit(MISSING_CONFIDENCE))
    agg = history.agg(
        F.count("*").alias("total"), F.count_if(_is("COMPLIANT")).alias("compliant"),
        F.count_if(_is("NON_COMPLIANT")).alias("non_compliant"), F.count_if(_is("WARNING")).alias("warning"),
        F.coalesce(F.sum("violations_count"), F.lit(0)).alias("total_violations"),
        F.avg(conf).alias("_conf"))
    return agg.select(
        "total", "compliant", "non_compliant", "warning",
        rate(F.col("compliant"), F.col("total")).alias("compliance_rate"), "total_violations",
        F.coalesce(F.floor(F.col("_conf") * 1000 + 0.5) / 10, F.lit(0.0)).alias("avg_confidence"))


def in_period(history: DataFrame, period: str, as_of: Column) -> DataFrame:
    """The last 7 or 30 days up to a date, or all of it."""
    if period == "all":
        return history
    days = {"7d": 7, "30d": 30}[period]
    day = F.to_date("raw_date")
    return history.filter((day > F.date_sub(as_of, days)) & (day <= as_of))


def daily_trend(history: DataFrame) -> DataFrame:
    """Totals and pass rate per day, with a row for every day in between."""
    days = history.groupBy(F.to_date("raw_date").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(_is("COMPLIANT")).alias("passed"),
        F.count_if(_is("NON_COMPLIANT")).alias("failed"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(
        F.explode(F.sequence("a", "b")).alias("day"))
    full = span.join(days, "day", "left").na.fill(0, ["total", "passed", "failed"])
    return full.select("day", "total", "passed", "failed",
                       rate(F.col("passed"), F.col("total"), 1).alias("rate"))


def top_violations(violations: DataFrame, limit: int = 4) -> DataFrame:
    """Most frequent violated rules with their share of all violations."""
    counts = violations.groupBy("rule_id").agg(F.count("*").alias("violations"))
    everything = Window.partitionBy()  # one row per rule
    share = counts.withColumn("all_violations", F.sum("violations").over(everything))
    percent = F.floor(F.col("violations") * 100 / F.col("all_violations") + 0.5).cast("int")
    severity = F.when(percent >= 25, "CRITICAL").when(percent >= 18, "HIGH").otherwise("MODERATE")
    return share.select("rule_id", "violations", percent.alias("percentage"), severity.alias("severity")
                        ).orderBy(F.desc("violations"), "rule_id").limit(limit)


def field_confidence(evidence: DataFrame) -> DataFrame:
    """Mean confidence of the values found, per field, in percent."""
    return evidence.filter("value is not null and confidence is not null").groupBy("field").agg(
        F.count("*").alias("declared"), half_up(F.avg("confidence") * 100, 10).alias("score"))


# lowest rate of each label; the labels come from sample figures, so callers may change them
BANDS = [(94, "EXCELLENT"), (90, "HIGH"), (75, "SATISFACTORY")]


def category_compliance(history: DataFrame, cuts: list = BANDS) -> DataFrame:
    agg = history.groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(_is("COMPLIANT")).alias("compliant"))
    r = F.floor(F.col("compliant") * 100 / F.col("total") + 0.5).cast("int")
    label = F.coalesce(*[F.when(F.col("rate") >= low, name) for low, name in cuts], F.lit("ATTENTION"))
    return agg.select("category", "total", r.alias("rate")).withColumn("band", label)


def score_band(score: Column) -> Column:
    safe = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5)))
    return (
        F.when(safe >= 85, "High Compliance").when(safe >= 60, "Violations Detected")
        .otherwise("Severe Non-Compliance"))


def score_bands(history: DataFrame) -> DataFrame:
    return history.groupBy(score_band(F.col("score")).alias("band")).agg(F.count("*").alias("scans"))
