"""Shape of candidates and evidence: the same columns for all eleven fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = {
    "confidence": "double", "x0": "double", "y0": "double", "x1": "double", "y1": "double",
    "image_index": "int",
}
EVIDENCE = {
    "value": "string", "raw_text": "string", **SOURCE, "context": "string",
    "unit": "string", "unit_status": "string", "currency": "string",
    "context_confirmed": "boolean", "date_role": "string", "parsed_date": "date",
    "role_source": "string", "inferred": "boolean", "partial": "boolean",
    "label_match": "string", "label_type": "string", "label_evidence": "string",
    "match_method": "string", "corrected_from_ocr": "boolean", "importer_mentioned": "boolean",
    "origin_conflict": "boolean", "prominence_ratio": "double", "name_score": "double",
}
# columns that survive the typed declaration contract
CONTRACT = [
    "value", "raw_text", "confidence", "x0", "y0", "x1", "y1", "context", "image_index", "unit",
    "unit_status", "currency", "context_confirmed", "date_role", "origin_conflict", "inferred",
]
# a line yields these; the rest of its evidence is the line itself
FINDING = {
    "field": "string", "tier": "int", "a": "int", "b": "double", "value": "string",
    "unit": "string", "unit_status": "string", "currency": "string",
    "context_confirmed": "boolean", "label_match": "string", "label_type": "string",
    "match_method": "string", "corrected_from_ocr": "boolean", "partial": "boolean",
}


def _struct_sql(values: dict[str, str], shape: dict[str, str]) -> str:
    """SQL of a struct with every column of a shape; columns not given are NULL."""
    return "named_struct(" + ", ".join(
        f"'{name}', cast({values.get(name, 'null')} as {kind})" for name, kind in shape.items()) + ")"


def finding(field: str, tier: int, value: str, when: str, **values: str) -> Column:
    """What one line yields for a field, if `when` holds; all arguments are SQL."""
    body = _struct_sql(
        {"field": f"'{field}'", "tier": str(tier), "value": value, "a": "0", "b": "0", **values}, FINDING)
    return F.expr(f"case when {when} then {body} end")


RANK = {"tier": "int", "a": "int", "b": "double", "pos": "bigint", "sub": "int"}


def rank(tier: str, pos: str, sub: str = "0", a: str = "0", b: str = "0") -> Column:
    """Sort key of a candidate, smallest first: tier, two scores, then place (SQL)."""
    return F.expr(_struct_sql({"tier": tier, "a": a, "b": b, "pos": pos, "sub": sub}, RANK))


def candidates(df: DataFrame, field: str, order: Column, **values: Column) -> DataFrame:
    """Rows of (scan_id, field, rank, ev).

    `field` is SQL. Evidence takes the columns of `df` that it names; `values`
    replace or add some.
    """
    named = df.withColumn("_rank", order)
    if values:
        named = named.withColumns(values)
    have = {n: n for n in EVIDENCE if n in named.columns}
    return named.selectExpr(
        "scan_id", f"{field} as field", "_rank as rank", f"{_struct_sql(have, EVIDENCE)} as ev")


def blank_evidence() -> str:
    return _struct_sql({}, EVIDENCE)
