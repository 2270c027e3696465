"""Rules: declared cases, every combination of states, scores, nested results."""

import itertools

import pytest

from labelscope.functions import patterns as P
from labelscope.operators import audit, rules
from labelscope.sources import catalog

CASE_SCHEMA = (
    "case_id long,rule_id string,field string,value string,confidence double,unit string,"
    "unit_status string,context_confirmed boolean,date_role string,origin_conflict boolean,"
    "inferred boolean,image_index int,x0 double,y0 double,x1 double,y1 double,is_imported boolean,"
    "may_expire boolean,requires_unit_sale_price boolean,dimensions_relevant boolean,expected_status string")
FIELD = {r["rule_id"]: r["field"] for r in catalog.RULES}


def case(i, rule, expected, **given):
    row = {"case_id": i, "rule_id": rule, "field": FIELD[rule], "expected_status": expected, **given}
    return tuple(row.get(c.split(" ")[0]) for c in CASE_SCHEMA.split(","))


MFG, EXP = "manufacturing", "best_before_use_by"
DECLARED = [
    ("PCR-R05", "PASS", dict(value="06/2026", date_role=MFG, confidence=0.95)),
    ("PCR-R08", "PASS", dict(value="06/2027", date_role=EXP, confidence=0.95, may_expire=True)),
    ("PCR-R05", "REVIEW", dict(value="06/2027", date_role="unclear", confidence=0.9)),
    ("PCR-R08", "REVIEW", dict(value="06/2027", date_role="unclear", confidence=0.9, may_expire=True)),
    ("PCR-R08", "FAIL", dict(may_expire=True)), ("PCR-R08", "REVIEW", {}),
    ("PCR-R08", "N/A", dict(may_expire=False)),
    ("PCR-R07", "PASS", dict(value="Japan", confidence=0.98, is_imported=True)),
    ("PCR-R07", "N/A", dict(is_imported=False)), ("PCR-R07", "REVIEW", {}),
    ("PCR-R04", "PASS", dict(value="120", confidence=0.98, context_confirmed=True)),
    ("PCR-R04", "REVIEW", dict(value="120", confidence=0.97, context_confirmed=False)),
    ("PCR-R05", "REVIEW", dict(value="07/2026", date_role=MFG, confidence=0.31)),
    ("PCR-R03", "FAIL", dict(value="500", unit_status="confirmed_absent", confidence=0.95)),
    ("PCR-R03", "REVIEW", dict(value="500", unit_status="ambiguous", confidence=0.9)),
    ("PCR-R09", "PASS", dict(value="18.50", unit="per 100g", confidence=0.92, requires_unit_sale_price=True)),
    ("PCR-R09", "FAIL", dict(requires_unit_sale_price=True)),
    ("PCR-R09", "N/A", dict(requires_unit_sale_price=False)),
    ("PCR-R10", "PASS", dict(value="30x20x10", unit="cm", confidence=0.9, dimensions_relevant=True)),
    ("PCR-R10", "N/A", dict(dimensions_relevant=False)), ("PCR-R10", "REVIEW", {}),
    ("PCR-R11", "REVIEW", {}),
]


def test_declared_cases(spark):
    rows = [case(i, rule, want, **given) for i, (rule, want, given) in enumerate(DECLARED)]
    out = rules.evaluate_cases(spark.createDataFrame(rows, CASE_SCHEMA), catalog.rules(spark)).collect()
    assert len(out) == len(DECLARED)
    assert [r for r in out if not r.matches] == []


def expected(rule, g):
    """The rule order spelled out for one evidence state."""
    if rule["rule_id"] in catalog.CONTEXT_KEYS:
        applies = g[catalog.CONTEXT_KEYS[rule["rule_id"]]]
        if applies is not True:
            return "N/A" if applies is False else "REVIEW"
    if not rule["validation"]["required"]:
        return "REVIEW"
    if g["value"] is None:
        return "FAIL"
    if g["confidence"] is not None and g["confidence"] < 0.6:
        return "REVIEW"
    kind, verdict = rule["validation"]["type"], "PASS"
    if kind == "value_and_unit":
        if g["unit_status"] == "ocr_corrected":
            return "REVIEW"
        if g["unit"] is None:
            return "FAIL" if g["unit_status"] == "confirmed_absent" else "REVIEW"
        verdict = "PASS" if g["unit"] in rule["validation"]["unit_in"] else "FAIL"
    elif kind == "presence_with_context" and g["context_confirmed"] is False:
        return "REVIEW"
    elif kind == "presence_with_role":
        if g["date_role"] in (None, "unclear"):
            return "REVIEW"
        verdict = "PASS" if g["date_role"] == rule["validation"]["expected_role"] else "FAIL"
    return "REVIEW" if verdict == "PASS" and g["origin_conflict"] else verdict


def test_every_state(spark):
    states = list(itertools.product(
        [None, "x"], [None, 0.59, 0.6], [None, "g", "oz"],
        [None, "confirmed_absent", "ambiguous", "ocr_corrected"], [None, True, False],
        [None, "unclear", MFG, EXP], [None, True], [None, True, False]))
    names = ["value", "confidence", "unit", "unit_status", "context_confirmed", "date_role", "origin_conflict"]
    rows, i = [], 0
    for rule in catalog.RULES:
        kind = rule["validation"]["type"]
        for s in states:
            g = dict(zip(names, s)) | {k: s[-1] for k in rules.CONTEXT}
            used = {"value_and_unit": {"unit", "unit_status"}, "presence_with_context": {"context_confirmed"},
                    "presence_with_role": {"date_role"}}.get(kind, set())
            if any(g[n] is not None for n in ("unit", "unit_status", "context_confirmed", "date_role")
                   if n not in used):
                continue
            rows.append(case(i, rule["rule_id"], expected(rule, g), **g))
            i += 1
    out = rules.evaluate_cases(spark.createDataFrame(rows, CASE_SCHEMA), catalog.rules(spark))
    assert out.count() == len(rows)
    assert out.filter("not matches").count() == 0


def evidence_of(spark, fields, scan_id=1, **context):
    rows = []
    for f in P.FIELDS:
        g = {"value": None, **fields.get(f, {})}
        rows.append((scan_id, f, g.get("value"), g.get("value"), g.get("confidence"), 1.0, 2.0, 3.0, 4.0, None,
                     g.get("image_index", 1), g.get("unit"), g.get("unit_status"), None,
                     g.get("context_confirmed"), g.get("date_role"), None, None, None,
                     context.get("is_imported"), context.get("may_expire"),
                     context.get("requires_unit_sale_price"), context.get("dimensions_relevant")))
    return spark.createDataFrame(rows, (
        "scan_id long,field string,value string,raw_text string,confidence double,x0 double,y0 double,"
        "x1 double,y1 double,context string,image_index int,unit string,unit_status string,currency string,"
        "context_confirmed boolean,date_role string,origin_conflict boolean,inferred boolean,"
        "nearby_text string,is_imported boolean,may_expire boolean,requires_unit_sale_price boolean,"
        "dimensions_relevant boolean"))


@pytest.mark.parametrize("passed,of,want", [(5, 8, 62), (0, 0, 0), (1, 8, 12), (3, 8, 38), (7, 8, 88), (9, 9, 100)])
def test_score_rounds_half_to_even(spark, passed, of, want):
    from pyspark.sql import functions as F

    row = spark.range(1).select(rules.score_of(F.lit(passed), F.lit(of)).alias("s")).first()
    assert row.s == want


def test_results_and_views(spark):
    ok = dict(value="x", confidence=0.9)
    ev = evidence_of(spark, {
        "manufacturer": ok, "common_name": {"value": " Oats ", "confidence": 0.9},
        "net_quantity": {**ok, "unit_status": "ambiguous"}, "mrp": {**ok, "context_confirmed": True},
        "manufacturing_date": {**ok, "date_role": MFG}}, is_imported=False, dimensions_relevant=False)
    results = rules.evaluate_rules(rules.contract(ev), catalog.rules(spark))
    status = {r.rule_id: r.status for r in results.collect()}
    assert status["PCR-R03"] == "REVIEW" and status["PCR-R06"] == "FAIL" and status["PCR-R07"] == "N/A"
    score = rules.scan_scores(results).first()
    assert (score.score, score.overall_status) == (50, "NON_COMPLIANT")
    nested = rules.scan_results(ev, results).first()
    assert nested.product.name == "Oats"
    assert [d.field for d in nested.declarations][:2] == ["manufacturer", "common_name"]
    assert {v.rule_id for v in nested.violations} == {"PCR-R03", "PCR-R06", "PCR-R08", "PCR-R09"}
    assert [v.evidence for v in nested.violations if v.rule_id == "PCR-R06"] == [None]
    matrix = audit.audit_matrix(ev.select("scan_id").distinct(), rules.violations(results),
                                rules.declarations(ev), catalog.rules(spark))
    rows = {r.rule_id: r.audit_status for r in matrix.filter("rule_ord < 1000").collect()}
    assert len(rows) == 11 and rows["PCR-R01"] == "PASSED" and rows["PCR-R10"] == "VERIFIED"
    # the quantity finding answers to the unit-price rule first, so that rule's own is listed apart
    assert [r.rule_id for r in matrix.filter("rule_ord >= 1000").collect()] == ["PCR-R09"]
    counts = audit.audit_counts(matrix).first()
    assert counts.failed == 5


def test_contract_quarantine(spark):
    bad = evidence_of(spark, {"mrp": dict(value="1", confidence=1.5)}, scan_id=2)
    good = evidence_of(spark, {"mrp": dict(value="1", confidence=0.5)}, scan_id=3)
    both = bad.unionByName(good)
    assert [(r.scan_id, r.error_code) for r in rules.contract_errors(both).collect()] == [(2, "EXTRACTION_FAILED")]
    assert {r.scan_id for r in rules.contract(both).collect()} == {3}


def test_strict_inferred(spark):
    from pyspark.sql import functions as F

    ev = evidence_of(spark, {"common_name": dict(value="x", confidence=0.9)}).withColumn(
        "inferred", F.col("field") == "common_name")
    for strict, want in ((False, "PASS"), (True, "REVIEW")):
        out = rules.evaluate_rules(ev, catalog.rules(spark), strict).filter("rule_id = 'PCR-R02'").first()
        assert out.status == want


def test_catalogue_files(spark, tmp_path):
    import json

    (tmp_path / "r.json").write_text(json.dumps({"rules": catalog.RULES}, indent=1))
    read = catalog.read_rules(spark, str(tmp_path / "r.json"))
    assert read.orderBy("rule_ord").collect() == catalog.rules(spark).orderBy("rule_ord").collect()
    joined = catalog.attach_exceptions(read, catalog.exceptions(spark))
    sizes = {r.rule_id: len(r.exceptions) for r in joined.collect()}
    assert sizes["PCR-R08"] == 2 and sizes["PCR-R01"] == 0
