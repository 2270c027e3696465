"""Audit views over rule results: matrix, guidance, search, evidence by image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import text as T
from labelscope.session import materialize


def _flat(field: Column) -> Column:
    return F.regexp_replace(F.lower(field), "[^a-z0-9]", "")


# --- fixed values: legacy codes and field words that also identify a rule -----
# rule: (codes it answers to, its field when that alone answers, words in a
# violation's field, rule codes on the violation)
ALIASES = {
    "PCR-R01": (["PCR-R01", "PCR-R6-1-A"], None, ["manufacturer", "packer"], ["PCR-R01", "PCR-R6-1-A"]),
    "PCR-R02": (["PCR-R02", "PCR-R6-1-B"], None, ["common_name", "product_name"], ["PCR-R02", "PCR-R6-1-B"]),
    "PCR-R03": (["PCR-R03", "PCR-R9", "PCR-R09"], "net_quantity", ["quantity"], ["PCR-R03", "PCR-R9"]),
    "PCR-R05": (["PCR-R05", "PCR-R6-1-D"], "manufacturing_date", ["manufactur", "mfd"], ["PCR-R05"]),
    "PCR-R08": (["PCR-R08", "PCR-R6-1-D"], "expiry_date", ["expir", "best_before"], ["PCR-R08"]),
    "PCR-R06": (["PCR-R06", "PCR-R6-1-F"], "consumer_care", ["consumer", "care", "helpline"],
                ["PCR-R06", "PCR-R6-1-F"]),
    "PCR-R07": (["PCR-R07"], "country_of_origin", ["origin"], ["PCR-R07"]),
    "PCR-R10": (["PCR-R10"], None, ["dimension", "size"], ["PCR-R10"]),
    "PCR-R11": (["PCR-R11"], None, ["colocation", "pdp"], ["PCR-R11"]),
}


def _has_any(field: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(field, F.lit(w))
    return hit


def same_rule(v_rule: Column, v_field: Column, rule: Column, field: Column) -> Column:
    """Whether a violation belongs to a rule, by code, field or a known alias."""
    code_v, code_r = T.rule_code(v_rule), T.rule_code(rule)
    flat_v, flat_r = _flat(v_field), _flat(field)
    match = (
        (v_rule == rule) | (v_field == field)
        | ((code_v != "") & (code_v == code_r))
        | ((flat_v != "") & (flat_r != "") & (F.contains(flat_v, flat_r) | F.contains(flat_r, flat_v))))
    for codes, own_field, words, v_codes in ALIASES.values():
        asked = rule.isin(codes)
        if own_field:
            asked = asked | (field == own_field)
        match = match | (asked & (_has_any(v_field, words) | v_rule.isin(v_codes)))
    price = rule.isin("PCR-R04", "PCR-R14") | (field == "mrp")
    match = match | (price & (
        (F.contains(v_field, F.lit("mrp")) & ~F.contains(v_field, F.lit("unit_sale")))
        | (v_field == "mrp") | (v_rule == "PCR-R04")))
    unit = rule.isin("PCR-R09", "PCR-R14") | (field == "unit_sale_price")
    match = match | (unit & (
        _has_any(v_field, ["unit_sale", "unit_price"]) | (v_rule == "PCR-R09")
        | ((v_rule == "PCR-R14") & F.contains(v_field, F.lit("unit")))))
    return F.coalesce(match, F.lit(False))


def same_declaration(d_field: Column, field: Column) -> Column:
    def plain(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[-_]", "")

    return (
        (d_field == field) | (plain(d_field) == plain(field))
        | ((field == "mrp") & F.contains(d_field, F.lit("mrp")))
        | ((field == "net_quantity") & F.contains(d_field, F.lit("quantity")))
        | ((field == "manufacturer") & F.contains(d_field, F.lit("manufacturer")))
        | ((field == "common_name") & _has_any(d_field, ["name", "product"])))


def _pairs(found: DataFrame, rule_table: DataFrame, matches: Column, kind: str) -> DataFrame:
    """Which rules each distinct (rule, field) of the findings answers to.

    The fuzzy match runs over distinct codes, not over findings.
    """
    return found.select(f"{kind}_rule", f"{kind}_field").distinct().join(
        rule_table.select("rule_ord", "rule_id", "field"), matches)


def audit_matrix(scans: DataFrame, violations: DataFrame, declared: DataFrame,
                 rule_table: DataFrame) -> DataFrame:
    """One row per scan and rule (FAILED, PASSED or VERIFIED), plus stray violations.

    The first violation that answers to a rule fails it; else the first
    matching declaration passes it. Violations no rule took are listed as well.
    """
    c = F.col
    v = violations.select(
        "scan_id", c("rule_ord").alias("v_ord"), c("rule_id").alias("v_rule"),
        c("field").alias("v_field"), "reason")
    d = declared.select(
        "scan_id", c("field_ord").alias("d_ord"), F.lit("").alias("d_rule"), c("field").alias("d_field"),
        c("value").alias("d_value"), c("confidence").alias("d_confidence"))
    v_map = _pairs(v, rule_table, same_rule(c("v_rule"), c("v_field"), c("rule_id"), c("field")), "v")
    d_map = _pairs(d, rule_table, same_declaration(c("d_field"), c("field")), "d")
    first_v = v.join(v_map, ["v_rule", "v_field"]).groupBy("scan_id", "rule_ord").agg(
        F.min(F.struct("v_ord", "v_rule", "v_field", "reason")).alias("v"))
    first_d = d.join(d_map, ["d_rule", "d_field"]).groupBy("scan_id", "rule_ord").agg(
        F.min(F.struct("d_ord", "d_field", "d_value", "d_confidence")).alias("d"))
    listed = rule_table.agg(F.array_sort(F.collect_list(F.struct(
        "rule_ord", "rule_id", "field", "legal_reference", "requirement"))).alias("rules"))
    grid = scans.select("scan_id").join(F.broadcast(listed)).select(  # one row of catalogue
        "scan_id", F.explode("rules").alias("r")).select("scan_id", "r.*")
    percent = F.floor(F.coalesce(c("d.d_confidence"), F.lit(0.95)) * 100 + 0.5).cast("string")
    matrix = (
        grid.join(first_v, ["scan_id", "rule_ord"], "left").join(first_d, ["scan_id", "rule_ord"], "left")
        .select(
            "scan_id", "rule_ord", "rule_id", "field",
            F.when(c("v").isNotNull(), "FAILED").when(c("d").isNotNull(), "PASSED")
            .otherwise("VERIFIED").alias("audit_status"),
            F.when(c("v").isNotNull(), c("v.reason")).when(
                c("d").isNotNull(),
                F.concat(F.lit('Detected: "'), c("d.d_value"), F.lit('" (Confidence: '), percent, F.lit("%)")))
            .otherwise("Statutory declaration verified against standard rules").alias("detail"),
            c("v.v_ord").alias("taken")))
    taken = first_v.select("scan_id", c("v.v_ord").alias("v_ord")).distinct()
    stray = v.join(taken, ["scan_id", "v_ord"], "left_anti").select(
        "scan_id", (c("v_ord") + 1000).alias("rule_ord"), F.coalesce("v_rule", F.lit("PCR-GEN")).alias("rule_id"),
        c("v_field").alias("field"), F.lit("FAILED").alias("audit_status"), c("reason").alias("detail"))
    return matrix.drop("taken").unionByName(stray)


def audit_filter(matrix: DataFrame, view: str = "all") -> DataFrame:
    wanted = {"all": None, "violations": ["FAILED"], "compliant": ["PASSED", "VERIFIED"]}[view]
    return matrix if wanted is None else matrix.filter(F.col("audit_status").isin(wanted))


def audit_counts(matrix: DataFrame) -> DataFrame:
    failed = F.col("audit_status") == "FAILED"
    return matrix.groupBy("scan_id").agg(
        F.count_if(failed).alias("failed"), F.count_if(~failed).alias("passed"))


# --- fixed values: guidance, first match wins --------------------------------
# (words in the field, words in the reason, advice)
GUIDANCE = [
    (["quantity"], ["unit"],
     "Declare net quantity with mandatory metric SI unit symbol (g, kg, ml, or l) with space between "
     "numeral and symbol (e.g. \"250 g\"). Ensure numeral height complies with Schedule II minimum font "
     "height standards for the package area."),
    (["mrp", "unit_sale_price"], ["unit sale"],
     "Print the Unit Sale Price (USP) clearly adjacent to the Maximum Retail Price (MRP) in standard "
     "format: \"₹X.XX per g\" or \"₹X.XX per ml\" in font size not less than prescribed under Rule 6(11) "
     "of PCR 2011."),
    (["date", "expiry"], ["month"],
     "Format date of manufacture/packaging in standard statutory format: \"MM/YYYY\" or \"Month and Year\" "
     "on principal display panel alongside \"Best Before\" duration."),
    (["fssai"], ["license"],
     "Display 14-digit FSSAI License Number with FSSAI statutory logo and green/brown Veg/Non-Veg icon "
     "conforming to FSSAI Packaging & Labelling Regulations 2018."),
    (["consumer", "care"], ["grievance"],
     "Provide complete consumer grievance redressal contact including telephone number, verified email "
     "address, and postal address of designated grievance officer."),
    (["manufacturer", "packer"], ["address"],
     "Provide full registered corporate entity name and complete physical address (including premise, "
     "locality, city, state, and pincode) of manufacturer or packer."),
]
DEFAULT_GUIDANCE = (
    "Rectify packaging declaration to strictly satisfy statutory requirements of Legal Metrology "
    "(Packaged Commodities) Rules, 2011 before commercial market release.")


def guidance(field: Column, reason: Column) -> Column:
    f, r = F.lower(F.coalesce(field, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    chain = F.coalesce(*[F.when(_has_any(f, fw) | _has_any(r, rw), advice) for fw, rw, advice in GUIDANCE])
    return F.coalesce(chain, F.lit(DEFAULT_GUIDANCE))


def corrective_actions(violations: DataFrame) -> DataFrame:
    return violations.select(
        "scan_id", "rule_id", "field", "status", guidance(F.col("field"), F.col("reason")).alias("guidance"))


def matching_rules(catalogue: DataFrame, text: str = "", applicability: str = "ALL", scoring: str = "all") -> DataFrame:
    """Rules of a catalogue with exceptions that match a text, an applicability and a scoring type."""
    c = F.col
    hit = F.lit(True)
    if applicability != "ALL":
        hit = hit & (c("applicability.type") == applicability)
    experimental = F.coalesce(F.contains(c("status"), F.lit("EXPERIMENTAL")), F.lit(False))
    if scoring == "scored":
        hit = hit & ~experimental
    if scoring == "experimental":
        hit = hit & experimental
    query = text.lower().strip()
    if query:
        def has(col: Column) -> Column:
            return F.coalesce(F.contains(F.lower(col), F.lit(query)), F.lit(False))

        plain = ["rule_id", "field", "requirement", "legal_reference", "applicability.condition",
                 "validation.type", "outputs.pass", "outputs.fail", "outputs.review", "outputs.na"]
        any_plain = F.lit(False)
        for name in plain:
            any_plain = any_plain | has(c(name))
        hit = hit & (
            any_plain | F.exists("evidence_required", has)
            | F.exists("exceptions", lambda e: has(e["id"]) | has(e["condition"]) | has(e["reasoning"])))
    return catalogue.filter(hit).select("rule_id", "requirement", "legal_reference")


def search_findings(results: DataFrame, catalogue: DataFrame, text: str = "",
                    applicability: str = "ALL", scoring: str = "all", *more: str) -> DataFrame:
    """Rule results whose rule matches a text, or one of `more`, an applicability and a scoring type.

    `catalogue` comes from `attach_exceptions`; it is filtered before the join,
    so only results of matching rules are read further. What matches is written,
    so that its size is known: a few rules hold all results, which a shuffle by
    rule would put into as many tasks.
    """
    found = reduce(DataFrame.unionByName, [matching_rules(catalogue, t, applicability, scoring) for t in (text, *more)])
    return results.join(materialize(found.distinct()), "rule_id").select(
        "scan_id", "rule_id", "field", "status", "reason", "requirement", "legal_reference")


def evidence_on_surface(violations: DataFrame, declared: DataFrame, image_index: int) -> DataFrame:
    """Findings and declarations with a valid box on one image of each scan."""
    def rows(df: DataFrame, kind: str) -> DataFrame:
        ok = T.valid_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        return df.filter((F.col("image_index") == image_index) & ok).select(
            "scan_id", F.lit(kind).alias("kind"), "field", "value", "x0", "y0", "x1", "y1")

    return rows(violations, "VIOLATION").unionByName(rows(declared, "DECLARATION"))
