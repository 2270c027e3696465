"""Registered queries: every job over whole tables of a data folder."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators import (
    analytics, audit, extract, history, layout, prominence, rules, sequence, tables, vocabulary,
)
from labelscope.plans import labels
from labelscope.plans.oracle import field_columns
from labelscope.session import materialize, scratch_dir
from labelscope.sources import catalog, detections, sinks

_STAGES: dict[tuple, DataFrame] = {}


def stage(name: str, build, write=materialize):
    """A stage table per session and folder: written once, shared by the queries; `write` is the identity where `build` writes."""

    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, name)
        if key not in _STAGES:
            _STAGES[key] = write(build(spark, folder))
        return _STAGES[key]

    return get


label_lines = stage("label_lines", labels.label_lines)
label_table = stage("label_table", labels.label_table)
evidence = stage("evidence", lambda s, d: extract.extract(label_lines(s, d)))
table_members = stage("members", lambda s, d: tables.table_blocks(label_table(s, d)), lambda written: written)
words = stage("words", lambda s, d: labels.label_detections(label_lines(s, d)))
results = stage("results", lambda s, d: rules.evaluate_rules(
    rules.contract(evidence(s, d)), catalog.rules(s)))


def _sequence(lines: DataFrame) -> DataFrame:
    return sequence.in_sequence(lines)


def _candidates(spark, folder):
    """Every line of the tables taken as a label, whatever it says."""
    ready = materialize(_sequence(label_table(spark, folder)))
    found = sequence.value_candidates(ready, ready)
    return found.select("scan_id", "pos", F.posexplode("cands").alias("i", "c")).select(
        "scan_id", "pos", (F.col("i") + 1).alias("place"), F.col("c.pos").alias("cand_pos"))


def _pairs(which):
    def run(spark, folder):
        return which(table_members(spark, folder)).select("scan_id", "l_pos", "v_pos")
    return run


def _table_pairs(spark, folder):
    return tables.table_pairs(table_members(spark, folder)).select("scan_id", "l_pos", "v_pos", "strategy")


def _merged(spark, folder):
    return tables.merge_columns(label_table(spark, folder)).filter("merged").select(
        "scan_id", "pos", "text", "confidence")


def _table_declarations(spark, folder):
    return extract.extract(label_table(spark, folder)).filter("value is not null").select(
        "scan_id", "field", "value", "raw_text", "date_role")


def _lines_read(spark, folder):
    return layout.read_labels(words(spark, folder)).select("scan_id", "pos", "text")


def _pages_read(spark, folder):
    """Words and errors of the labels' recogniser output, written as JSON lines of both layouts and read again."""
    pages = materialize(labels.label_pages(label_lines(spark, folder)))
    read = []
    for layout in detections.LAYOUTS:
        path = f"{scratch_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
        pages.filter(F.col("layout") == layout).select("value").write.text(path)
        read.append(detections.read_checked(spark, path, layout))
    return [reduce(DataFrame.unionByName, part) for part in zip(*read)]


def _detections_read(spark, folder):
    words, _ = _pages_read(spark, folder)
    clean = detections.normalise(detections.number_images(words))
    return detections.rescale(clean, F.when(F.col("scan_id") % 3 == 0, 2.0).otherwise(1.0)).select(
        "scan_id", "image_index", "word_ord", "text", "x0", "y0", "x1", "y1", "confidence")


def _detection_errors(spark, folder):
    _, errors = _pages_read(spark, folder)
    return errors.groupBy("scan_id", "image_path", "i", "reason").agg(
        F.count("*").alias("n"), F.count(detections.RECORD).alias("records"))


def _orientation(spark, folder):
    lines = materialize(layout.lines_both_ways(words(spark, folder)).drop("words", "confidence"), free=True)
    return layout.choose_orientation(layout.orientation_scores(lines))


def _field(field):
    def run(spark, folder):
        return evidence(spark, folder).filter(F.col("field") == field).select(*field_columns(field))
    return run


def _names(spark, folder):
    """Names ranked with the first line of every label set larger than the rest."""
    first = F.col("pos") == 0
    lines = label_lines(spark, folder).withColumn(
        "y0", F.when(first, F.col("y0") - 30).otherwise(F.col("y0")))
    ranked = prominence.rank_phrases(lines)
    return ranked.select("scan_id", "idx", "value", "final_score", "prominence_ratio", "descriptors")


def _care_text(spark, folder):
    """Unlabelled contacts of document texts: an email, else a phone-shaped number."""
    text = F.col("text")
    hits = labels.text_lines(spark, folder).select(
        "scan_id", "pos", F.explode(F.array(
            F.struct(F.lit(2).alias("tier"), T.email_in(text).alias("value")),
            F.struct(F.lit(3).alias("tier"), T.phone_by_shape(text).alias("value")))).alias("h")
    ).filter("h.value is not null")
    order = F.struct("h.tier", "pos")
    return hits.groupBy("scan_id").agg(
        F.min_by("h.value", order).alias("value"), F.min("h.tier").alias("tier"))


def _dates_text(spark, folder):
    """Every date-shaped text of the documents, separators cleaned."""
    numbered = labels.text_lines(spark, folder).filter(T.has_digit(F.col("text")))
    return numbered.select(
        "scan_id", "pos", F.explode(T.matches(F.col("text"), P.DATE_SHAPE, 1)).alias("raw")
    ).select("scan_id", "pos", T.clean_date(F.col("raw")).alias("date_text"))


def _declared(spark, folder):
    return rules.declarations(evidence(spark, folder))


def _cases(spark, folder):
    """Labelled cases enumerated over the parts: one rule and evidence state each."""
    k = F.col("p_partkey").cast("bigint")
    part = labels.table(spark, folder, "part").select("p_partkey")
    r = (k % 11 + 1).cast("int")

    def step(n: int, m: int):
        return F.floor(k / n) % m

    applies = F.when(step(11, 3) == 0, True).when(step(11, 3) == 1, False)
    unit = step(3, 4)
    role = step(2, 4)
    fields = F.array(*[F.lit(rule["field"]) for rule in catalog.RULES])
    return part.select(
        k.alias("case_id"), F.format_string("PCR-R%02d", r).alias("rule_id"),
        F.element_at(fields, r).alias("field"),
        F.when(k % 7 != 0, "x").alias("value"),
        F.when(k % 13 != 0, (k % 100) / 100.0).alias("confidence"),
        F.when(unit.isin(0, 3), "g").alias("unit"),
        F.when(unit == 0, "confirmed_present").when(unit == 1, "confirmed_absent")
        .when(unit == 2, "ambiguous").otherwise("ocr_corrected").alias("unit_status"),
        F.when(step(5, 3) == 1, False).when(step(5, 3) == 2, True).alias("context_confirmed"),
        F.when(role == 1, "manufacturing").when(role == 2, "best_before_use_by").when(role == 3, "unclear")
        .alias("date_role"),
        F.when(k % 17 == 0, True).alias("origin_conflict"), F.lit(None).cast("boolean").alias("inferred"),
        F.lit(1).alias("image_index"),
        *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")],
        *[applies.alias(c) for c in rules.CONTEXT],
        F.element_at(F.array(F.lit("PASS"), F.lit("REVIEW"), F.lit("FAIL")), (k % 3).cast("int") + 1)
        .alias("expected_status"))


def _case_eval(spark, folder):
    return rules.confusion(rules.evaluate_cases(_cases(spark, folder), catalog.rules(spark)))


def _violations(spark, folder):
    return rules.violations(results(spark, folder))


def _audit(spark, folder):
    found = audit.audit_matrix(
        evidence(spark, folder).select("scan_id").distinct(), _violations(spark, folder),
        _declared(spark, folder), catalog.rules(spark))
    return found.select("scan_id", "rule_id", "field", "audit_status", "detail")


def _audit_counts(spark, folder):
    return audit.audit_counts(_audit(spark, folder))


def _broken(spark, folder):
    """Evidence of which some scans break the contract in one field each, by key."""
    def broken(n: int, field: str):
        return (F.col("scan_id") % 10 == n) & (F.col("field") == field)

    return evidence(spark, folder).withColumns({
        "unit_status": F.when(broken(3, "net_quantity"), "guessed").otherwise(F.col("unit_status")),
        "confidence": F.when(broken(4, "mrp"), 1.5).otherwise(F.col("confidence")),
        "image_index": F.when(broken(5, "expiry_date"), 4).otherwise(F.col("image_index")),
        "date_role": F.when(broken(6, "manufacturing_date"), "later").otherwise(F.col("date_role"))})


def _percent_boxes(spark, folder):
    """Boxes and image sizes made of the numbers of line items, some out of order, out of range or empty."""
    n = lambda c: F.col(c).cast("bigint")
    box = T.percent_box(
        (n("l_quantity") - 2).cast("double"), (n("l_linenumber") * 10).cast("double"), (n("l_partkey") % 80).cast("double"),
        (n("l_suppkey") % 60).cast("double"), n("l_partkey") % 7 * 10, n("l_suppkey") % 5 * 10)
    return labels.table(spark, folder, "lineitem").select(
        n("l_orderkey").alias("scan_id"), "l_linenumber", box.alias("b")).filter("b is not null").select(
        "scan_id", "l_linenumber", "b.*")


def _sorted(by):
    def run(spark, folder):
        return history.numbered(_history(spark, folder), by).select("place", "id", "score", "raw_date")
    return run


def _search(*words):
    def run(spark, folder):
        known = catalog.attach_exceptions(catalog.rules(spark), catalog.exceptions(spark))
        found = audit.search_findings(results(spark, folder), known, words[0], "ALL", "all", *words[1:])
        return found.select("scan_id", "rule_id", "field", "status", "reason")
    return run


def _scan_results(spark, folder):
    return rules.scan_results(rules.contract(evidence(spark, folder)), results(spark, folder))


def _history(spark, folder):
    e = F.col("event_id")
    kind = F.col("event_type")
    return labels.table(spark, folder, "events").select(
        F.concat(F.lit("insp_"), e.cast("string")).alias("id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), kind.alias("category"),
        F.when(kind.isin("purchase", "signup"), "COMPLIANT").when(kind == "error", "NON_COMPLIANT")
        .otherwise("WARNING").alias("status"),
        F.least(F.col("value"), F.lit(100.0)).alias("score"), F.col("ts").alias("raw_date"),
        (e % 5).cast("int").alias("violations_count"), (e % 11).cast("int").alias("declarations_count"),
        ((e % 101) / 100.0).alias("mean_confidence"), (e % 10 == 0).alias("is_demo"))


def _kpis_week(spark, folder):
    h = _history(spark, folder)
    last = h.agg(F.max(F.to_date("raw_date")).alias("last"))  # one row
    return analytics.compliance_kpis(
        analytics.in_period(h.join(F.broadcast(last)), "7d", F.col("last")))


def _history_search(spark, folder):
    return history.search(_history(spark, folder), "User 1", "COMPLIANT", "LIVE").select(
        "id", "name", "category", "status", "score", "is_demo")


def _history_upsert(spark, folder):
    """One item per user: the earlier half upserted by the later half of the items."""
    items = _history(spark, folder).select(
        F.col("name").alias("id"), F.col("id").alias("name"), "category", "status", "score", "raw_date",
        "violations_count", "declarations_count", "mean_confidence", "is_demo").filter(~F.col("is_demo"))
    middle = items.agg(F.expr("timestamp_seconds((unix_timestamp(min(raw_date)) + unix_timestamp(max(raw_date))) div 2)").alias("mid"))
    split = items.join(F.broadcast(middle))
    return history.upsert(
        split.filter(F.col("raw_date") <= F.col("mid")), split.filter(F.col("raw_date") > F.col("mid"))
    ).select("id", "status", "score", "raw_date")


def _history_load(spark, folder):
    h = _history(spark, folder)
    return history.load(h.filter(~F.col("is_demo")), h.filter("is_demo")).select("id", "status", "source_rank")


def _history_items(spark, folder):
    return history.history_items(_scan_results(spark, folder), F.lit("2024-01-01")).select(
        "id", "status", "score", "violations_count", "declarations_count", "mean_confidence")


def _manifest(spark, folder):
    """Uploads per order: its line items stand for its images."""
    items = labels.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    orders = labels.table(spark, folder, "orders").select(F.col("o_orderkey").cast("bigint").alias("scan_id"))
    part = F.col("l_partkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "PNG", "webp", "gif")]), ((part % 23).cast("int") % 4) + 1)
    uploads = orders.join(items, F.col("scan_id") == F.col("l_orderkey"), "left").select(
        "scan_id",
        F.when(part.isNotNull(), F.concat(F.lit("image_"), F.col("l_linenumber").cast("string"), F.lit("."), ext)).alias("filename"),
        F.when(part.isNotNull(), F.when(part % 2 == 0, "application/octet-stream").otherwise("image/png; q=1")).alias("content_type"),
        (F.col("q") % 29).alias("length"), F.col("l_linenumber").alias("ordinal"))
    return detections.check_manifest(uploads).select("scan_id", "images", "error_code", "filename")


def queries() -> dict:
    q = {
        "line_context": lambda s, d: _sequence(label_lines(s, d)).select("scan_id", "pos", "ctx1", "ctx2"),
        "label_value_candidates": _candidates,
        "detections_to_lines": _lines_read,
        "detections_read": _detections_read,
        "detection_errors": _detection_errors,
        "page_orientation": _orientation,
        "table_pairs_row": _pairs(tables.pairs_by_row),
        "table_pairs_rank": _pairs(tables.pairs_by_rank),
        "table_pairs_geometry": _pairs(tables.pairs_by_geometry),
        "table_pairs": _table_pairs,
        "table_merged_lines": _merged,
        "table_declarations": _table_declarations,
        "unit_resolution": lambda s, d: vocabulary.resolved_units(label_lines(s, d)),
        "fuzzy_labels": lambda s, d: vocabulary.garbled_labels(label_lines(s, d)),
        "descriptor_scores": lambda s, d: vocabulary.descriptor_scores(label_lines(s, d)),
        "descriptor_scores_text": lambda s, d: vocabulary.descriptor_scores(labels.text_lines(s, d)),
        "product_name_rank": _names,
        "consumer_care_text": _care_text,
        "dates_text": _dates_text,
        "declarations": lambda s, d: _declared(s, d).select(
            "scan_id", "field_ord", "field", "value", "confidence", "unit", "date_role"),
        "contract_errors": lambda s, d: rules.contract_errors(_broken(s, d)),
        "rule_results": lambda s, d: results(s, d).select(
            "scan_id", "rule_id", "field", "status", "reason", "scored", "value", "confidence"),
        "scan_scores": lambda s, d: rules.scan_scores(results(s, d)).select(
            "scan_id", "score", "overall_status"),
        "violations": lambda s, d: _violations(s, d).select(
            "scan_id", "rule_id", "field", "status", "reason", "value"),
        "labelled_case_eval": _case_eval,
        "audit_matrix": _audit,
        "audit_counts": _audit_counts,
        **{f"audit_{v}": lambda s, d, v=v: audit.audit_filter(_audit(s, d), v) for v in ("violations", "compliant")},
        "percent_boxes": _percent_boxes,
        "findings_search": _search("sale", "retail price"),
        **{f"findings_search_{w}": _search(w) for w in ("fssai", "verified", "government")},
        "corrective_actions": lambda s, d: audit.corrective_actions(_violations(s, d)),
        "evidence_by_surface": lambda s, d: audit.evidence_on_surface(
            _violations(s, d), _declared(s, d), 1).select("scan_id", "kind", "field", "value"),
        "csv_findings": lambda s, d: sinks.csv_findings(_scan_results(s, d)),
        "field_confidence": lambda s, d: analytics.field_confidence(evidence(s, d)),
        "top_violations": lambda s, d: analytics.top_violations(_violations(s, d)),
        "compliance_kpis": lambda s, d: analytics.compliance_kpis(_history(s, d)),
        "compliance_kpis_7d": _kpis_week,
        "daily_trend": lambda s, d: analytics.daily_trend(_history(s, d)),
        "category_compliance": lambda s, d: analytics.category_compliance(_history(s, d)),
        "score_bands": lambda s, d: analytics.score_bands(_history(s, d)),
        "history_search": _history_search,
        "history_upsert": _history_upsert,
        "history_load": _history_load,
        "history_sort_date": _sorted("date-desc"),
        "history_sort_score": _sorted("score-asc"),
        "history_from_results": _history_items,
        "manifest_check": _manifest,
    }
    for rule in catalog.RULES[:10]:
        q[f"extract_{rule['field']}"] = _field(rule["field"])
    return q
