"""Field extraction: candidate rows from lines and labels, best one per field.

Every job is the same shape. Lines yield candidates with a sort key, in one
pass over the table; label lines yield more from their neighbours; a min_by
aggregate keeps the best per scan and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.functions import fuzzy
from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators.evidence import EVIDENCE, blank_evidence, candidates, finding, rank
from labelscope.operators.sequence import BOX, in_sequence, value_candidates
from labelscope.operators.tables import merge_columns, readable
from labelscope.options import DEFAULT, Options
from labelscope.session import materialize

LABEL_MAKER, LABEL_NAME, LABEL_QUANTITY, LABEL_DATE, LABEL_DURATION, LABEL_ORIGIN = (
    1, 2, 4, 8, 16, 32)
IMPORTER_FLAG, BLANK_FIELD = "_importer", "_blank"


def _c(name: str) -> Column:
    return F.col(name)


def ready_lines(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Sequenced lines with similarity bits, label kinds, a name on its label's line and shelf-life labels, as a stage table.

    `following` is kept for label lines only, so the table stays near the size
    of the texts and their context.
    """
    bits = fuzzy.resembles(_c("text")) if options.fuzzy_labels else F.lit(0)
    text, low = _c("text"), _c("low")
    has_date = T.has_digit(text) & T.found(text, P.DATE_SHAPE)
    flags = [
        (LABEL_MAKER, (T.says(low, *P.MAKER_PARTS) & T.found(text, P.MAKER_ALONE))
         | (T.says(low, *P.AGENT_PARTS) & T.found(text, P.AGENT_ALONE))
         | (_c("bits").bitwiseAND(fuzzy.MAKER | fuzzy.AGENT) > 0)),
        (LABEL_NAME, T.says(low, *P.NAME_PARTS) & T.found(T.trimmed(text), P.NAME_ALONE)),
        (LABEL_QUANTITY, T.says(low, *P.QTY_PARTS) & T.found(text, P.QTY_ALONE)),
        (LABEL_DATE, T.says(low, *P.MFG_PARTS, *P.EXP_PARTS) & ~_c("has_date") & (T.date_role_of(text) != "unclear")),
        (LABEL_DURATION, T.says(low, *P.EXP_PARTS) & T.found(text, P.DURATION_LABEL) & T.duration_in(
            T.after_match(text, P.DURATION_LABEL, P.TAIL_LENGTH)).isNull()),
        (LABEL_ORIGIN, (T.says(low, *P.ORIGIN_PARTS) & T.found(text, P.ORIGIN_ALONE))
         | (_c("bits").bitwiseAND(fuzzy.ORIGIN) > 0)),
    ]
    kinds = F.lit(0)
    for bit, cond in flags:
        kinds = kinds + F.when(cond, bit).otherwise(0)
    return materialize(
        in_sequence(lines).withColumn("bits", bits)  # after the shuffle: evenly spread
        .withColumn("has_date", has_date)
        .withColumn("low", F.lower(text)).withColumns({
            "kinds": kinds, "lasts": T.says(low, *P.EXP_PARTS) & T.found(text, P.DURATION_LABEL),
            "name": F.when(T.says(low, *P.NAME_PARTS), T.strip_value(T.group(text, P.NAME_VALUE, 1)))}).drop("low")
        .withColumn("following", F.when(_c("kinds") > 0, _c("following")))
        .withColumn("ctx1", F.when(_c("has_date"), _c("ctx1")))
    )


def label_lines_with_values(ready: DataFrame) -> DataFrame:
    labels = ready.filter("kinds > 0").select(
        "scan_id", "run", "pos", "image_index", "text", "confidence", *BOX, "ctx2", "bits",
        "kinds", "following")
    return value_candidates(labels, ready)


# --- quantity ---------------------------------------------------------------
def _not_quantity(text: Column, number: Column, unit: Column) -> Column:
    """Gross weights, recipe and network contexts, and marks such as 5G."""
    return T.found(text, P.GROSS) | T.found(text, P.QTY_FALSE_CONTEXT) | F.coalesce(
        (unit == "G") & number.rlike(r"^0*[0-5]$"), F.lit(False))


def _unit_status(how: str, unit: str, options: Options) -> str:
    """SQL of the unit status of a quantity reading."""
    blurred = f"confidence < {P.LOW_QUANTITY_CONFIDENCE}" if options.confidence_gating else "false"
    return (
        f"case when {how} = 'swallowed' then 'ocr_corrected' when {how} is not null then 'confirmed_present' "
        f"when {unit} is not null or coalesce({blurred}, false) then 'ambiguous' else 'confirmed_absent' end")


def _corrected(how: str) -> str:
    return f"coalesce({how} in ('repaired', 'swallowed'), false)"


# --- one pass over the lines ------------------------------------------------
def line_candidates(ready: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """All candidates that a single line can give."""
    text, c = _c("text"), _c

    def said(parts: list[str]) -> Column:
        return T.says(c("low"), *parts)

    def numeric(pattern: str, idx: int, parts: list[str]) -> Column:
        return F.when(c("digit") & said(parts) if parts else c("digit"), T.group(text, pattern, idx))

    def also(first: str, pattern: str, idx: int) -> Column:
        return F.when(c(first).isNotNull(), T.group(text, pattern, idx))

    # most lines match few patterns: second groups and vetoes run on hits only
    read = ready.withColumns({"digit": T.has_digit(text), "low": F.lower(text)}).select(
        "scan_id", "pos", "image_index", "text", "low", "confidence", *BOX, "ctx2", "bits",
        F.when(said(P.MAKER_PARTS), T.strip_value(T.group(text, P.MAKER_VALUE, 1))).alias("maker"),
        F.when(said(P.AGENT_PARTS), T.strip_value(T.group(text, P.AGENT_VALUE, 1))).alias("agent"),
        "name",
        numeric(P.QTY_VALUE, 1, P.QTY_PARTS).alias("q_num"), numeric(P.QTY_PLAIN, 1, []).alias("p_num"),
        numeric(P.USP_VALUE, 2, P.USP_PARTS).alias("usp"),
        numeric(P.PER_UNIT_PRICE, 2, P.PER_UNIT_PARTS).alias("per_amount"),
        F.when(c("digit") & said(P.MRP_PARTS) & T.found(text, P.MRP_LABEL), T.amount_after(text, P.MRP_LABEL)).alias("mrp"),
        numeric(P.CURRENCY_AMOUNT, 1, P.CURRENCY_PARTS).alias("bare"), numeric(P.PRICE_LABEL, 2, ["price"]).alias("price"),
        numeric(P.PHONE_LOOSE, 1, []).alias("loose"), numeric(P.DIMENSIONS, 1, P.DIMENSION_PARTS).alias("dims"),
        T.email_in(text).alias("email"), T.phone_by_shape(text).alias("phone"),
        (said(P.ORIGIN_PARTS) & T.found(text, P.ORIGIN_VALUE)).alias("has_origin"),
        (said(["imported"]) & T.found(text, P.IMPORTED_BY)).alias("importer"),
    )
    second = read.withColumns({
        "q_unit": also("q_num", P.QTY_VALUE, 2), "p_unit": also("p_num", P.QTY_PLAIN, 2),
        "usp_unit": also("usp", P.USP_VALUE, 3), "per_unit": also("per_amount", P.PER_UNIT_PRICE, 3),
        "dims_unit": also("dims", P.DIMENSIONS, 2),
        "origin": F.when(c("has_origin"), F.coalesce(*[
            F.nullif(T.strip_value(T.group(text, P.ORIGIN_VALUE, i)), F.lit("")) for i in range(1, 5)])),
    })
    bare_ok = T.plausible_price(c("bare"))
    per_unit_form = F.coalesce(c("per_amount") == c("bare"), F.lit(False))
    settled = second.withColumns({
        "q": F.when(c("q_num").isNotNull() & ~_not_quantity(text, c("q_num"), c("q_unit")),
                    T.resolve_unit(c("q_num"), c("q_unit"), True)),
        "p": F.when(c("p_num").isNotNull() & ~_not_quantity(text, c("p_num"), c("p_unit"))
                    & ~T.found(text, P.DIMENSIONS_LIKE) & ~T.found(text, P.USP_LINE),
                    T.resolve_unit(c("p_num"), c("p_unit"), False)),
        "priced": F.coalesce("mrp", "bare", "price").isNotNull() & c("usp").isNull()
        & ~T.found(text, P.USP_LINE) & ~T.found(text, P.NOT_MRP_CONTEXT),
        "plain_price": F.when(bare_ok, F.when(~per_unit_form, c("bare"))).when(
            T.plausible_price(c("price")), c("price")),
        "per_ok": c("per_amount").isNotNull() & ~T.found(text, P.QTY_FALSE_CONTEXT)
        & T.plausible_price(c("per_amount")),
        "is_care": F.coalesce("loose", "email").isNotNull() & (
            (said(P.CARE_PARTS) & T.found(text, P.CARE_WORDS)) | (c("bits").bitwiseAND(fuzzy.CARE) > 0)),
        "clean_origin": F.when(c("origin").rlike("[A-Za-z]"), T.clean_origin(c("origin"))),
        "maker_hint": T.found(c("maker"), P.COMPANY_HINT).cast("int"),
        "agent_hint": T.found(c("agent"), P.COMPANY_HINT).cast("int"),
        "usp_norm": T.norm_unit(c("usp_unit")), "per_norm": T.norm_unit(c("per_unit")),
        "dims_norm": T.norm_unit(c("dims_unit")),
    })

    def maker(name: str, tier: int) -> Column:
        kind = "manufacturer" if tier else "packer_importer_marketer"
        return finding(
            "manufacturer", 1, name, f"{name} != ''", a=f"-({name}_hint + {4 * tier + 2})",
            b="-coalesce(confidence, 0)", label_match="'exact'", label_type=f"'{kind}'")

    def quantity(name: str, tier: int, when: str) -> Column:
        how = f"{name}.how"
        return finding(
            "net_quantity", tier, f"{name}.value", when, unit=f"{name}.unit",
            unit_status=_unit_status(how, f"{name}_unit", options), corrected_from_ocr=_corrected(how))

    def price(tier: int, amount: str, when: str, **more: str) -> Column:
        return finding("mrp", tier, f"replace({amount}, ',', '')", f"priced and {when}",
                       currency="'INR'", **more)

    def unit_price(tier: int, amount: str, unit: str, when: str, method: str) -> Column:
        return finding("unit_sale_price", tier, f"replace({amount}, ',', '')", when, unit=unit,
                       currency="'INR'", match_method=f"'{method}'")

    items = F.array(
        maker("maker", 1), maker("agent", 0),
        finding("common_name", 1, "name", "name != ''", match_method="'explicit_label'"),
        quantity("q", 1, "q is not null"), quantity("p", 3, "p.unit is not null"),
        price(1, "mrp", "mrp is not null", context_confirmed="true"),
        price(2, "plain_price", "mrp is null and plain_price is not null"),
        finding("consumer_care", 1, "coalesce(loose, email)", "is_care and coalesce(loose, email) is not null"),
        finding("consumer_care", 2, "email", "email is not null", partial="true"),
        finding("consumer_care", 3, "phone", "phone is not null", partial="true"),
        finding("country_of_origin", 1, "clean_origin", "clean_origin is not null"),
        unit_price(1, "usp", "usp_norm", "usp is not null", "explicit_label"),
        unit_price(2, "per_amount", "per_norm", "per_ok", "per_unit_form"),
        finding("dimensions", 1, "trim(dims)", "dims is not null", unit="dims_norm"),
        finding(IMPORTER_FLAG, 1, "'true'", "importer"),
    )
    keep = ["scan_id", "pos", "image_index", "confidence", *BOX]
    hits = (
        settled.select(*keep, text.alias("raw_text"), c("ctx2").alias("context"), items.alias("items"))
        .select(*keep, "raw_text", "context",
                F.explode(F.filter("items", lambda x: x.isNotNull())).alias("f"))
        .select(*keep, "raw_text", "context", "f.*")
    )
    return candidates(hits, "field", rank("tier", "pos", "0", "a", "b"))


# --- label lines and their neighbours ---------------------------------------
def _stop_at(stop) -> Column:
    """1-based place of the first candidate that ends the search, or 0."""
    return F.array_position(
        F.transform("cands", lambda x: F.coalesce(stop(T.strip_value(x["text"])), F.lit(False))),
        F.lit(True))


def _neighbours(labels: DataFrame, kind: int, count: int, stop=None) -> DataFrame:
    """One row per label line of a kind and candidate ahead of the stop."""
    df = labels.filter(_c("kinds").bitwiseAND(kind) > 0)
    if stop is not None:
        at = _stop_at(stop)
        df = df.withColumn("cands", F.when(at > 0, F.slice("cands", F.lit(1), (at - 1).cast("int")))
                           .otherwise(_c("cands")))
    return df.select(
        "scan_id", _c("pos").alias("label_pos"), _c("text").alias("label"),
        _c("ctx2").alias("label_context"), "bits",
        F.posexplode(F.slice("cands", 1, count)).alias("i", "line"),
    ).select("scan_id", "label_pos", "label", "label_context", "bits", "i", "line.*")


def label_makers(labels: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Name and address: all candidates up to the next declaration compete."""

    def stop(value: Column) -> Column:
        return (value != "") & (
            T.found(value, P.OTHER_DECLARATION) | F.contains(F.lower(value), F.lit("customer care")))

    rows = _neighbours(labels, LABEL_MAKER, 5, stop).withColumn("value", T.strip_value(_c("text")))
    rows = rows.filter(readable(_c("confidence"), options) & (T.letters(_c("value")) >= 3))
    exact_maker, exact_agent = T.found(_c("label"), P.MAKER_ALONE), T.found(_c("label"), P.AGENT_ALONE)
    is_maker = exact_maker | (~exact_agent & (_c("bits").bitwiseAND(fuzzy.MAKER) > 0))
    graded = rows.withColumns({
        "hint": T.found(_c("value"), P.COMPANY_HINT), "exact": exact_maker | exact_agent,
        "is_maker": is_maker,
        "raw_text": F.concat_ws(" ", "label", "value"), "context": _c("ctx2"),
    })
    return candidates(
        graded, "'manufacturer'",
        rank("1", f"label_pos + {1 << 41}", "i",
             "-(cast(hint as int) + 2 * cast(exact as int) + 4 * cast(is_maker as int))",
             "-coalesce(confidence, 0)"),
        label_match=F.expr("if(exact, 'exact', 'fuzzy')"),
        label_type=F.expr("if(is_maker, 'manufacturer', 'packer_importer_marketer')"))


def label_names(labels: DataFrame, options: Options = DEFAULT) -> DataFrame:
    rows = _neighbours(labels, LABEL_NAME, 2).withColumn("value", T.strip_value(_c("text")))
    blocked = F.lit(False)
    for word in P.NAME_BLOCKERS:
        blocked = blocked | F.contains(F.lower("value"), F.lit(word))
    usable = rows.filter(
        readable(_c("confidence"), options) & ~blocked & _c("value").rlike("[A-Za-z]"))
    return candidates(
        usable, "'common_name'", rank("2", "label_pos", "i"), raw_text=_c("text"),
        context=_c("label_context"), label_evidence=_c("label"),
        match_method=F.lit("explicit_label"))


def label_quantities(labels: DataFrame, options: Options = DEFAULT) -> DataFrame:
    text = _c("text")
    rows = _neighbours(labels, LABEL_QUANTITY, 2).withColumns({
        "plain": T.group(text, P.QTY_PLAIN, 1), "named": T.group(text, P.QTY_VALUE, 1),
    }).withColumns({
        "number": F.coalesce("plain", "named", T.group(text, P.QTY_BARE, 1)),
        "raw_unit": F.when(_c("plain").isNotNull(), T.group(text, P.QTY_PLAIN, 2)).when(
            _c("named").isNotNull(), T.group(text, P.QTY_VALUE, 2)),
    })
    read = (
        rows.filter(_c("number").isNotNull() & ~_not_quantity(text, _c("number"), _c("raw_unit")))
        .withColumn("q", T.resolve_unit(_c("number"), _c("raw_unit"), True))
    )
    return candidates(
        read, "'net_quantity'", rank("2", "label_pos", "i"),
        value=_c("q.value"), unit=_c("q.unit"),
        unit_status=F.expr(_unit_status("q.how", "raw_unit", options)),
        corrected_from_ocr=F.expr(_corrected("q.how")),
        raw_text=T.strip_space(F.concat_ws(" ", "label", "text")), context=_c("label_context"))


def label_origins(labels: DataFrame, options: Options = DEFAULT) -> DataFrame:
    rows = _neighbours(labels, LABEL_ORIGIN, 2).withColumn("word", T.strip_value(_c("text")))
    usable = rows.filter(readable(_c("confidence"), options) & (T.letters(_c("word")) >= 3))
    return candidates(
        usable.withColumn("value", T.clean_origin(_c("word"))), "'country_of_origin'",
        rank("2", "label_pos", "i"), raw_text=F.concat_ws(" ", "label", "word"),
        context=_c("ctx2"),
        label_match=F.when(T.found(_c("label"), P.ORIGIN_ALONE), "exact").otherwise("fuzzy"))


def label_candidates(labels: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Candidates whose value sits on a neighbour of a label-only line."""
    return (
        label_makers(labels, options).unionByName(label_names(labels, options))
        .unionByName(label_quantities(labels, options)).unionByName(label_origins(labels, options))
    )


# --- dates ------------------------------------------------------------------
def _date_rows(df: DataFrame, source: int, i: Column) -> DataFrame:
    """Common columns: text and image of a date, its role, place and evidence."""
    return df.select(
        "scan_id", "image_index", "date_text", "role", F.lit(source).alias("source"),
        F.struct(F.lit(source).alias("source"), _c("seq_pos").cast("bigint").alias("pos"),
                 i.cast("bigint").alias("i")).alias("seq"),
        F.struct(_c("date_text").alias("value"), "raw_text", "confidence", *BOX, "image_index",
                 "context", _c("day").alias("parsed_date")).alias("ev"))


def line_dates(ready: DataFrame) -> DataFrame:
    """Dates on their own line, each with the role its text supports."""
    text = _c("text")
    hits = (
        ready.filter("has_date")
        .select("scan_id", "pos", "image_index", "text", "confidence", *BOX, "ctx1",
                F.explode(T.date_matches(text)).alias("m"))
        .withColumn("date_text", T.clean_date(T.strip_space(_c("m.raw"))))
        .filter(~T.phone_fragment(text, _c("date_text")))
        .withColumn("read", T.read_date(_c("date_text"))).filter("read.ok")
    )
    line_mfg, line_exp = T.found(text, P.MFG_WORDS), T.found(text, P.EXP_WORDS)
    role = F.coalesce(
        T.role_before(_c("m.prefix")),
        F.when(line_mfg & ~line_exp, "manufacturing").when(line_exp & ~line_mfg, "best_before_use_by")
        .when(line_mfg & line_exp, "unclear"),
        T.date_role_of(F.concat_ws(" ", text, _c("ctx1"))))
    roled = hits.withColumn("role", role).filter(
        (_c("role") != "unclear") | ~T.found(text, P.NOT_DATE_CONTEXT))
    return _date_rows(
        roled.withColumns({"seq_pos": _c("pos"), "raw_text": text, "context": _c("ctx1"),
                           "day": _c("read.day")}), 1, _c("m.i"))


def label_dates(labels: DataFrame) -> DataFrame:
    """Dates that a date label without one finds on its nearest dated candidate."""

    def stop(value: Column) -> Column:
        other = T.found(value, P.MFG_WORDS) | T.found(value, P.EXP_WORDS) | T.found(
            value, P.DECLARATION_START)
        return (value != "") & ~T.found(value, P.DATE_SHAPE) & other

    near = _neighbours(labels, LABEL_DATE, 3, stop).withColumn("raw_text", T.strip_space(_c("text")))
    dated = (
        near.select("*", F.posexplode(T.matches(_c("raw_text"), P.DATE_SHAPE, 1)).alias("k", "raw"))
        .withColumn("date_text", T.strip_space(_c("raw")))
        .filter(~T.phone_fragment(_c("raw_text"), _c("date_text")))
        .withColumn("read", T.read_date(_c("date_text"))).filter("read.ok")
    )
    nearest = F.min("i").over(Window.partitionBy("scan_id", "label_pos"))  # five lines at most
    return _date_rows(
        dated.withColumn("first", nearest).filter(_c("i") == _c("first"))
        .withColumns({"seq_pos": _c("label_pos"), "context": _c("ctx2"), "day": _c("read.day"),
                      "role": T.date_role_of(_c("label"))}), 2, _c("k"))


def durations(ready: DataFrame, labels: DataFrame) -> DataFrame:
    """Shelf lives after a best-before label, on its line or on the next ones."""
    text = _c("text")
    same = ready.filter("lasts").withColumn(
        "date_text", T.duration_in(T.after_match(text, P.DURATION_LABEL, P.TAIL_LENGTH)))
    near = labels.filter(_c("kinds").bitwiseAND(LABEL_DURATION) > 0)
    at = _stop_at(lambda value: T.found(value, P.DECLARATION_START))
    ahead = F.slice("cands", F.lit(1), F.when(at > 0, F.least(at - 1, F.lit(2))).otherwise(2).cast("int"))
    lives = F.transform(ahead, lambda x: T.duration_in(T.strip_space(x["text"])))
    below = near.withColumn("lives", lives).withColumn(
        "date_text", F.get(F.filter("lives", lambda v: v.isNotNull()), F.lit(0)))
    keep = ["scan_id", "pos", "image_index", "text", "confidence", *BOX, "ctx2", "date_text"]
    rows = same.select(*keep).unionByName(below.select(*keep)).filter("date_text is not null")
    return _date_rows(
        rows.withColumns({"seq_pos": _c("pos"), "raw_text": text, "context": _c("ctx2"),
                          "role": F.lit("best_before_use_by"), "day": F.lit(None).cast("date")}),
        3, F.lit(0))


def all_dates(ready: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per date found, in the order found, label roles applied.

    A label that reaches a date already read without a role gives it that role
    in place; any other association adds a date unless the same text, image and
    role is there already.
    """
    # one shuffle by scan serves all three aggregations below
    seen = line_dates(ready).unionByName(label_dates(labels)).repartition("scan_id")
    once = seen.groupBy("scan_id", "image_index", "date_text", "role", "source").agg(
        F.min_by(F.struct("seq", "ev"), "seq").alias("e"))
    # at most three roles from lines and two from labels: a bounded list per text
    entry = F.struct("e.seq", "role", "e.ev")
    grouped = (
        once.groupBy("scan_id", "image_index", "date_text").agg(
            F.collect_list(F.when(_c("source") == 1, entry)).alias("own"),
            F.collect_list(F.when(_c("source") == 2, entry)).alias("linked"),
            F.min_by("role", F.when(_c("source") == 2, _c("e.seq"))).alias("new_role"),
            F.min(F.when(_c("source") == 2, _c("e.seq"))).alias("new_seq"),
            F.bool_or((_c("source") == 1) & (_c("role") == "unclear")).alias("open"))
        .withColumn("upgrades", _c("open") & _c("new_seq").isNotNull())
        .withColumn("own", F.transform("own", lambda x: F.struct(
            x["seq"].alias("seq"),
            F.when(_c("upgrades") & (x["role"] == "unclear"), _c("new_role")).otherwise(x["role"]).alias("role"),
            x["ev"].alias("ev"))))
        .withColumn("roles", F.transform("own", lambda x: x["role"]))
        .withColumn("added", F.filter("linked", lambda x: ~(
            _c("upgrades") & (x["seq"] == _c("new_seq"))) & ~F.array_contains(_c("roles"), x["role"])))
    )
    merged = grouped.select("scan_id", F.explode(F.concat("own", "added")).alias("x"))
    lives = durations(ready, labels).select("scan_id", "seq", "role", "ev")
    return merged.select("scan_id", "x.seq", "x.role", "x.ev").unionByName(lives)


def date_fields(dates: DataFrame) -> DataFrame:
    """Manufacturing and expiry slots per scan, by label and else by chronology."""
    day = _c("ev.parsed_date")
    dated, expiry = day.isNotNull(), _c("role") == "best_before_use_by"
    maker_slot = _c("role").isin("manufacturing", "unclear")
    entry, order = F.struct("role", "ev"), F.struct(day, _c("seq"))
    agg = dates.groupBy("scan_id").agg(
        F.min_by(entry, F.when(maker_slot, _c("seq"))).alias("m"),
        F.min_by(entry, F.when(expiry, _c("seq"))).alias("e"),
        F.count_if(dated).alias("n_dated"),
        F.count_if(dated & (_c("role") != "unclear")).alias("n_roled"),
        F.min_by("ev", F.when(dated, order)).alias("early"),
        F.max_by("ev", F.when(dated, order)).alias("late"))
    by_time = F.coalesce(
        ~F.coalesce(_c("m.role") == "manufacturing", F.lit(False)) & _c("e").isNull()
        & (_c("n_dated") == 2) & (_c("n_roled") == 0)
        & (_c("early.parsed_date") < _c("late.parsed_date"))
        & (_c("early.image_index") == _c("late.image_index")), F.lit(False))

    def slot(field: str, role: str, labelled: str, timed: str) -> Column:
        plain = F.when(_c(labelled).isNotNull(), F.struct(
            F.lit(field).alias("field"), _c(f"{labelled}.role").alias("date_role"),
            _c(f"{labelled}.ev").alias("d")))
        return F.when(_c("by_time"), F.struct(
            F.lit(field).alias("field"), F.lit(role).alias("date_role"), _c(timed).alias("d"))
        ).otherwise(plain)

    slots = (
        agg.withColumn("by_time", by_time)
        .select("scan_id", "by_time", F.explode(F.array(
            slot("manufacturing_date", "manufacturing", "m", "early"),
            slot("expiry_date", "best_before_use_by", "e", "late"))).alias("s"))
        .filter("s is not null")
        .select("scan_id", "by_time", "s.field", "s.date_role", "s.d.*")
    )
    return candidates(
        slots, "field", rank("1", "0"),
        inferred=F.when(_c("by_time"), True), role_source=F.when(_c("by_time"), "chronology"))


# --- assembly ---------------------------------------------------------------
def blank_scans(scans: DataFrame) -> DataFrame:
    """A candidate of no field for every scan, which `assemble` turns into the fields that nothing was found for."""
    return scans.select(
        "scan_id", F.lit(BLANK_FIELD).alias("field"), rank("99", "0").alias("rank"), F.expr(blank_evidence()).alias("ev"))


def choose(rows: DataFrame) -> DataFrame:
    """Best candidate per scan and field, with the number of plain prices seen.

    A scan has hardly more candidates than fields, so rows are not combined
    before the shuffle; it serves the scan's window in `assemble` as well.
    """
    return rows.repartition("scan_id").groupBy("scan_id", "field").agg(
        F.min_by("ev", "rank").alias("ev"), F.min("rank").alias("rank"),
        F.count_if((_c("field") == "mrp") & (_c("rank.tier") == 2)).alias("prices"))


def assemble(chosen: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Evidence rows of all eleven fields with the product context of the scan."""
    scan = Window.partitionBy("scan_id")  # twelve rows at most
    confirmed = F.when((_c("field") == "mrp") & (_c("rank.tier") == 2), _c("prices") == 1) \
        .otherwise(_c("ev.context_confirmed"))

    def of_field(field: str) -> Column:
        return F.max(F.when(_c("field") == field, _c("ev.value"))).over(scan)

    fields = F.array(*[F.lit(f) for f in P.FIELDS if f != P.PLACEMENT_FIELD])
    own = F.when(_c("field") == BLANK_FIELD, F.array_except(fields, "_fields")).otherwise(F.array("field"))

    wide = chosen.withColumns({
        "_importer_seen": of_field(IMPORTER_FLAG).isNotNull(),
        "_origin": of_field("country_of_origin"),
        "_expiry": of_field("expiry_date"),
        "_fields": F.collect_set("field").over(scan),
    }).filter(_c("field") != IMPORTER_FLAG)
    indian = T.is_india(_c("_origin"))
    clash = _c("_importer_seen") & indian
    imported = (
        F.when(_c("_origin").isNull(), F.when(_c("_importer_seen"), True))
        .when(clash, F.lit(False if options.origin_overrides_importer else None).cast("boolean"))
        .when(_c("_importer_seen"), True)
        .otherwise(~indian))
    is_origin = (_c("field") == "country_of_origin") & _c("ev.value").isNotNull()
    over = {
        "context_confirmed": confirmed,
        "importer_mentioned": F.when(is_origin & _c("_importer_seen"), True),
        "origin_conflict": F.when(is_origin & clash, True),
    }
    rows = wide.select(
        "scan_id", own.alias("_own"),
        *[over.get(n, _c(f"ev.{n}")).cast(k).alias(n) for n, k in EVIDENCE.items()],
        imported.alias("is_imported"),
        F.when(_c("_expiry").isNotNull(), True).alias("may_expire"),
        F.lit(options.unit_sale_price_applicable).cast("boolean").alias("requires_unit_sale_price"),
        F.lit(options.dimensions_applicable).cast("boolean").alias("dimensions_relevant"))
    columns = [c for c in rows.columns if c not in ("scan_id", "_own")]
    return with_placement(rows.select("scan_id", F.explode("_own").alias("field"), *columns))


def with_placement(rows: DataFrame) -> DataFrame:
    """Add the placement row of each scan: where the manufacturer evidence sits.

    The manufacturer row is split in two in place, so nothing is read twice.
    """
    kept = {"scan_id", "x0", "y0", "x1", "y1", "is_imported", "may_expire",
            "requires_unit_sale_price", "dimensions_relevant"}
    copies = F.when(_c("field") == "manufacturer", F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False)))
    split = rows.withColumn("_placed", F.explode(copies))
    columns = [
        F.expr(f"if(_placed, '{P.PLACEMENT_FIELD}', field)").alias("field") if c == "field"
        else _c(c) if c in kept else F.expr(f"if(_placed, null, {c})").alias(c) for c in rows.columns]
    return split.select(*columns, F.expr("if(_placed, context, null)").alias("nearby_text"))


def extract(lines: DataFrame, options: Options = DEFAULT, scans: DataFrame | None = None) -> DataFrame:
    """Lines of many scans to evidence: eleven rows per scan.

    `lines` has scan_id, pos (0-based reading order), image_index, text, box,
    confidence, row_index and column_index. `scans` adds scans without lines.
    """
    from labelscope.operators.prominence import prominent_names
    from labelscope.operators.vocabulary import descriptor_names

    combined = merge_columns(lines, options)
    ready = ready_lines(combined, options)
    labels = materialize(label_lines_with_values(ready))
    direct = line_candidates(ready, options).unionByName(label_candidates(labels, options))
    # a name found by its label comes first, so other names are sought for the other scans only
    named = (
        ready.filter("name != ''").select("scan_id")
        .unionByName(label_names(labels, options).select("scan_id")).distinct()
    )
    unnamed = materialize(ready.select(
        "scan_id", "pos", "image_index", "text", "confidence", *BOX, "ctx2"
    ).join(named, "scan_id", "left_anti"))
    descriptors = materialize(descriptor_names(unnamed, options))
    unnamed = unnamed.join(descriptors.select("scan_id"), "scan_id", "left_anti")
    everyone = lines.select("scan_id").distinct() if scans is None else (
        lines.select("scan_id").unionByName(scans.select("scan_id")).distinct())
    found = (
        direct.unionByName(descriptors)
        .unionByName(prominent_names(unnamed, options))
        .unionByName(date_fields(all_dates(ready, labels)))
        .unionByName(blank_scans(everyone))
    )
    return assemble(choose(found), options)
