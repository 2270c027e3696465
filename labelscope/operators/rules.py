"""Rule evaluation, scores, violations and the nested scan result.

Evidence is long (eleven rows per scan), so a rule is an equi-join on the field
name with an eleven-row table plus a chain of column conditions. Only scores
and results regroup by scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import patterns as P
from labelscope.operators.evidence import CONTRACT
from labelscope.sources.catalog import CONTEXT_KEYS, EXPERIMENTAL_REASON

CONTEXT = ["is_imported", "may_expire", "requires_unit_sale_price", "dimensions_relevant"]
STATUSES = {"unit_status": ["confirmed_present", "confirmed_absent", "ambiguous", "ocr_corrected"],
            "date_role": ["manufacturing", "best_before_use_by", "unclear"]}


def contract_errors(evidence: DataFrame) -> DataFrame:
    """Scans whose evidence breaks the declaration contract, with the reason."""
    c = F.col
    checks = {
        "confidence out of range": ~c("confidence").between(0.0, 1.0),
        "image_index out of range": ~c("image_index").between(1, 3),
        **{f"unknown {name}": ~c(name).isin(allowed) for name, allowed in STATUSES.items()},
    }
    reason = F.coalesce(*[F.when(bad, text) for text, bad in checks.items()])
    return (
        evidence.withColumn("error", reason).filter("error is not null")
        .groupBy("scan_id").agg(F.min(F.struct("field", "error")).alias("e"))
        .select("scan_id", F.lit("EXTRACTION_FAILED").alias("error_code"),
                "e.field", "e.error")
    )


def contract(evidence: DataFrame) -> DataFrame:
    """Evidence as the contract keeps it: declared columns only, bad scans left out."""
    declared = evidence.select("scan_id", "field", *CONTRACT, "nearby_text", *CONTEXT)
    return declared.join(contract_errors(evidence).select("scan_id"), "scan_id", "left_anti")


def evaluate_rules(evidence: DataFrame, rule_table: DataFrame, strict_inferred: bool = False) -> DataFrame:
    """Status, reason and evidence of every rule for every scan.

    `evidence` has one row per scan and field with the four context columns.
    `strict_inferred` sends inferred values to REVIEW, which is off by default.
    """
    c = F.col
    catalogue = rule_table.select(
        "rule_ord", "rule_id", "field", "validation", "outputs",
        (F.coalesce(c("status").startswith("EXPERIMENTAL"), F.lit(False))
         | ~F.coalesce(c("validation.required"), F.lit(True))).alias("experimental"))
    rows = evidence.join(catalogue, "field")
    conditional = c("rule_id").isin(list(CONTEXT_KEYS))
    applies = F.coalesce(*[F.when(c("rule_id") == rule, c(key)) for rule, key in CONTEXT_KEYS.items()])
    kind = c("validation.type")
    unit_gate = (
        F.when(c("unit_status") == "ocr_corrected", "REVIEW")
        .when(c("unit").isNull(), F.when(c("unit_status") == "confirmed_absent", "FAIL").otherwise("REVIEW"))
        .when(F.array_contains("validation.unit_in", c("unit")), "PASS").otherwise("FAIL"))
    context_gate = F.when(c("context_confirmed").eqNullSafe(F.lit(False)), "REVIEW").otherwise("PASS")
    role_gate = (
        F.when(c("date_role").isNull() | (c("date_role") == "unclear"), "REVIEW")
        .when(c("date_role") == c("validation.expected_role"), "PASS").otherwise("FAIL"))
    verdict = (
        F.when(kind == "value_and_unit", unit_gate)
        .when(kind == "presence_with_context", context_gate)
        .when(kind == "presence_with_role", role_gate)
        .otherwise("PASS"))
    doubtful = F.coalesce(c("origin_conflict"), F.lit(False))
    if strict_inferred:
        doubtful = doubtful | F.coalesce(c("inferred"), F.lit(False))
    checked = rows.withColumns({"_v": verdict, "_applies": applies})
    status = (
        F.when(conditional & c("_applies").isNull(), "REVIEW")
        .when(conditional & ~c("_applies"), "N/A")
        .when(c("experimental"), "REVIEW")
        .when(c("value").isNull(), "FAIL")
        .when(c("confidence") < P.REVIEW_CONFIDENCE, "REVIEW")
        .when((c("_v") == "PASS") & doubtful, "REVIEW")
        .otherwise(c("_v")))
    judged = checked.withColumn("status", status)
    settled = conditional & c("_applies").isNull()
    reason = (
        F.when(c("experimental") & ~settled & (c("status") == "REVIEW"), EXPERIMENTAL_REASON)
        .when(c("status") == "PASS", c("outputs.pass")).when(c("status") == "FAIL", c("outputs.fail"))
        .when(c("status") == "REVIEW", c("outputs.review")).otherwise(c("outputs.na")))
    no_evidence = (c("status") == "N/A") | ((c("status") == "FAIL") & c("value").isNull())
    return judged.select(
        "scan_id", "rule_ord", "rule_id", "field", "status", reason.alias("reason"),
        (~c("experimental")).alias("scored"), (~no_evidence).alias("has_evidence"),
        *[F.when(~no_evidence, c(n)).alias(n) for n in
          ("value", "confidence", "image_index", "x0", "y0", "x1", "y1")])


def score_of(passed: Column, applicable: Column) -> Column:
    """Share of passed rules in percent, half to even, 0 when none applies."""
    share = F.when(applicable > 0, F.bround(passed / applicable * 100, 0))
    return F.coalesce(share, F.lit(0.0)).cast("int")


def scan_scores(results: DataFrame) -> DataFrame:
    """Score, overall status and status counts per scan."""
    c = F.col
    counted = c("scored") & (c("status") != "N/A")
    agg = results.groupBy("scan_id").agg(
        F.count_if(counted & (c("status") == "PASS")).alias("passed"),
        F.count_if(counted).alias("applicable"),
        F.count_if(c("scored") & (c("status") == "FAIL")).alias("failed"),
        F.count_if(c("scored") & (c("status") == "REVIEW")).alias("review"))
    overall = (
        F.when(c("failed") > 0, "NON_COMPLIANT").when(c("review") > 0, "WARNING").otherwise("COMPLIANT"))
    return agg.select("scan_id", score_of(c("passed"), c("applicable")).alias("score"),
                      overall.alias("overall_status"), "passed", "applicable", "failed", "review")


def violations(results: DataFrame) -> DataFrame:
    """Scored failures and reviews as public findings."""
    c = F.col
    return results.filter(c("scored") & c("status").isin("FAIL", "REVIEW")).select(
        "scan_id", "rule_ord", "rule_id", "field",
        F.when(c("status") == "FAIL", "NON_COMPLIANT").otherwise("WARNING").alias("status"),
        "reason", "has_evidence", "value", "image_index", "x0", "y0", "x1", "y1")


def declarations(evidence: DataFrame) -> DataFrame:
    """Declared fields with a value, in catalogue order; placement left out."""
    order = F.array_position(F.array(*[F.lit(f) for f in P.FIELDS]), F.col("field"))
    return evidence.filter((F.col("field") != P.PLACEMENT_FIELD) & F.col("value").isNotNull()).select(
        "scan_id", order.cast("int").alias("field_ord"), "field", *CONTRACT)


def product_names(evidence: DataFrame) -> DataFrame:
    name = F.trim(F.col("value"))
    return evidence.filter(F.col("field") == "common_name").select(
        "scan_id", F.lit("packaged_commodity").alias("product_type"),
        F.when(F.col("value") != "", name).otherwise("Packaged Commodity").alias("product_name")
    ).fillna({"product_name": "Packaged Commodity"})


def scan_results(evidence: DataFrame, results: DataFrame) -> DataFrame:
    """One nested result per scan: product, status, score, declarations, violations.

    A scan has eleven rows of each input at most, so its lists are short.
    """
    def box():
        return F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1")).alias("bbox")

    declared = declarations(evidence).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(
        "field_ord", "field", *[n for n in CONTRACT if n not in ("x0", "y0", "x1", "y1")], box()))
    ).alias("declarations"))
    found = violations(results).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(
        "rule_ord", "rule_id", "field", "status", "reason",
        F.when(F.col("has_evidence"), F.struct("value", "image_index", box())).alias("evidence")))
    ).alias("violations"))
    return (
        scan_scores(results).select("scan_id", "overall_status", "score")
        .join(product_names(evidence), "scan_id", "left")
        .join(declared, "scan_id", "left").join(found, "scan_id", "left")
        .select(
            "scan_id", F.struct(F.col("product_type").alias("type"), F.col("product_name").alias("name")
                                ).alias("product"),
            "overall_status", "score",
            F.coalesce("declarations", F.array()).alias("declarations"),
            F.coalesce("violations", F.array()).alias("violations"))
    )


def evaluate_cases(cases: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Labelled cases through the rules: expected and computed status per case.

    `cases` has case_id, rule_id, expected_status, the evidence columns and the
    context columns; a case without a known rule is skipped.
    """
    keyed = cases.drop("rule_id").withColumn("scan_id", F.col("case_id"))
    results = evaluate_rules(keyed, rule_table).select(
        F.col("scan_id").alias("case_id"), "rule_id", F.col("status").alias("got"))
    return cases.select("case_id", "rule_id", F.col("expected_status").alias("expected")).join(
        results, ["case_id", "rule_id"]
    ).withColumn("matches", F.col("expected") == F.col("got"))


def confusion(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("rule_id", "expected", "got").agg(F.count("*").alias("cases"))
