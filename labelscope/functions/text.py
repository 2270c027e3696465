"""Column expressions for label text: matching, units, amounts, dates, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, body) -> Column:
    """Bind a value once for use in `body`, so that nested uses do not copy it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- matching ---------------------------------------------------------------
def found(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def group(text: Column, pattern: str, idx: int) -> Column:
    """Capture group of the first match; NULL when it took no part in it."""
    g = F.regexp_extract(text, pattern, idx)
    return F.when(g != "", g)


def matches(text: Column, pattern: str, idx: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(idx))


def after_match(text: Column, pattern: str, length: int) -> Column:
    """The given number of characters that follow the first match, else NULL."""
    tail = F.get(F.split(text, pattern, 2), F.lit(1))
    return F.substring(tail, 1, length)


def has_digit(text: Column) -> Column:
    """Cheap test that spares number patterns on most lines."""
    return text.rlike(r"\p{Nd}")


def says(low: Column, *parts: str) -> Column:
    """Cheap test that spares patterns on most lines: whether a lower-case text has one of some ASCII parts.

    Texts with other characters always pass, as some of these fold to letters.
    """
    test = F.octet_length(low) != F.length(low)
    for part in parts:
        test = test | F.contains(low, F.lit(part))
    return test


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trimmed(text: Column) -> Column:
    """`strip_space` of a plain column: most texts have no space at the ends, which their first and last characters tell."""
    tidy = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(tidy, text).otherwise(strip_space(text))


def strip_value(text: Column) -> Column:
    """Value clean-up: no blank, full stop or comma at either end."""
    return F.btrim(text, F.lit(" .,"))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def token_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def name_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def collapse_repeats(text: Column) -> Column:
    """Drop a word that repeats the one before it, whatever its case."""
    words = F.split(strip_space(text), r"(?U)\s+")
    return let(words, lambda ws: F.array_join(
        F.transform(ws, lambda w, i: F.when(
            (i == 0) | (F.lower(w) != F.lower(F.get(ws, i - 1))), w)), " "))


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


# --- units ------------------------------------------------------------------
def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def norm_unit(raw: Column) -> Column:
    unit = F.lower(F.btrim(raw, F.lit(".")))
    return F.coalesce(F.element_at(_literal_map(P.UNIT_ALIASES), unit), unit)


def valid_unit(unit: Column) -> Column:
    return F.coalesce(unit.isin(P.VALID_UNITS), F.lit(False))


def repaired_unit(raw: Column) -> Column:
    """Undo digit-for-letter confusion, then take the unit word within one edit.

    The nearest word wins and ties go to the alphabetically first one.
    """
    guess = F.translate(F.lower(F.btrim(raw, F.lit("."))), "90158", "golsb")
    words = F.array(*[F.lit(w) for w in sorted(P.VALID_UNITS + list(P.UNIT_ALIASES))])
    near = let(guess, lambda g: F.array_min(F.filter(
        F.transform(words, lambda w: F.struct(F.levenshtein(g, w).alias("d"), w.alias("w"))),
        lambda x: x["d"] <= 1)))
    return F.when(raw != "", let(near["w"], lambda w: F.coalesce(
        F.element_at(_literal_map(P.UNIT_ALIASES), w), w)))


def swallowed_unit(value: Column) -> Column:
    """struct(number, unit) hidden in an all-digit value such as 4009 = 400 g."""

    def cut(n: int) -> Column:
        size = F.length(value)
        unit = norm_unit(F.translate(F.right(value, F.lit(n)), "9150", "glso"))
        ok = value.rlike(rf"^\d*[1-9]\d*[9150]{{{n}}}$") & valid_unit(unit)
        return F.when(ok, F.struct(
            F.substring(value, F.lit(1), size - n).alias("number"), unit.alias("unit")))

    return F.coalesce(cut(2), cut(1))


def resolve_unit(value: Column, raw: Column, labelled: bool) -> Column:
    """struct(value, unit, how): exact, alias, repaired or swallowed; unit NULL if unknown.

    `unit` is always a valid unit. A swallowed unit needs a labelled quantity.
    """

    def settle(exact: Column) -> Column:
        known = F.when(
            valid_unit(exact),
            F.struct(value.alias("value"), exact.alias("unit"),
                     F.when(exact == F.lower(raw), "exact").otherwise("alias").alias("how")))
        mended = F.when(raw.isNotNull(), let(
            repaired_unit(raw), lambda u: F.when(valid_unit(u), F.struct(
                value.alias("value"), u.alias("unit"), F.lit("repaired").alias("how")))))
        tail = F.when(raw.isNull(), let(
            swallowed_unit(value), lambda t: F.when(t.isNotNull(), F.struct(
                t["number"].alias("value"), t["unit"].alias("unit"), F.lit("swallowed").alias("how")))))
        none = F.struct(value.alias("value"), F.lit(None).cast("string").alias("unit"),
                        F.lit(None).cast("string").alias("how"))
        return F.coalesce(known, mended, *([tail] if labelled else []), none)

    return let(norm_unit(raw), settle)


# --- amounts ----------------------------------------------------------------
def plain_amount(amount: Column) -> Column:
    return F.replace(amount, F.lit(","), F.lit(""))


def plausible_price(amount: Column) -> Column:
    return F.coalesce(let(strip_space(plain_amount(amount)), lambda c: c.rlike(
        r"^\d{1,9}(?:\.\d{1,2})?$") & c.try_cast("double").between(1e-9, 1_000_000.0)), F.lit(False))


def amount_after(text: Column, label: str) -> Column:
    """First plausible amount near the label, preferring one with decimals."""
    tail = after_match(text, label, P.TAIL_LENGTH)
    amounts = F.filter(matches(tail, P.AMOUNT), plausible_price)
    return let(amounts, lambda found_: F.coalesce(
        F.get(F.filter(found_, lambda a: F.contains(a, F.lit("."))), F.lit(0)),
        F.get(found_, F.lit(0))))


# --- dates ------------------------------------------------------------------
def clean_date(text: Column) -> Column:
    return strip_space(F.regexp_replace(text, P.SEPARATOR_RUN, "$1"))


# shapes of a cleaned date and the parts of each, in the order they are tried
_GAP = r"[/\-., \s]*"
DAY_MONTH = P.rx(rf"^(\d{{1,2}}){_GAP}({P.MONTH_NAMES})\.?{_GAP}(\d{{2,4}})$")
MONTH_DAY = P.rx(rf"^({P.MONTH_NAMES})\.?{_GAP}(\d{{1,2}})[/\-., \s]+(\d{{2,4}})$")
MONTH_ONLY = P.rx(rf"^({P.MONTH_NAMES})\.?{_GAP}(\d{{3,6}})$")
NUMERIC = P.rx(r"^(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})$")
YEAR_FIRST = P.rx(r"^(\d{4})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{1,2})$")
# a lone decimal point beside another separator reads as a decimal number
DECIMAL_MIX = P.rx(r"^\d+\.\d+[/\-]|[/\-]\d+\.\d+$")


def _month_number(name: Column) -> Column:
    return F.element_at(
        _literal_map({m: str(i + 1) for i, m in enumerate(P.MONTHS)}),
        F.lower(F.substring(name, 1, 3)))


def _parts(text: Column) -> Column:
    """struct(kind, d, m, y): day, month and year digits as read by shape."""

    def of(kind: str, pattern: str, d: int, m: int, y: int) -> Column:
        month = F.regexp_extract(text, pattern, m)
        named = kind in ("day_month", "month_day")
        return F.struct(
            F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, d).alias("d"),
            (_month_number(month) if named else month).alias("m"),
            F.regexp_extract(text, pattern, y).alias("y"))

    run = F.regexp_extract(text, MONTH_ONLY, 2)
    month_only = F.struct(F.lit("month_only").alias("kind"), run.alias("d"),
                          F.lit("").alias("m"), F.lit("").alias("y"))
    return (
        F.when(text.rlike(DECIMAL_MIX), None)
        .when(text.rlike(DAY_MONTH), of("day_month", DAY_MONTH, 1, 2, 3))
        .when(text.rlike(MONTH_DAY), of("month_day", MONTH_DAY, 2, 1, 3))
        .when(text.rlike(NUMERIC), of("numeric", NUMERIC, 1, 2, 3))
        .when(text.rlike(YEAR_FIRST), of("year_first", YEAR_FIRST, 3, 2, 1))
        .when(text.rlike(MONTH_ONLY), month_only)
    )


def _ordered(p: Column) -> Column:
    """Swap the parts where the printed order cannot be day, month, year.

    Day comes first, also after a leading year. A first number past 31 is a
    year when the last has two digits; a middle number past 12 is a day.
    """
    d, m = p["d"].try_cast("int"), p["m"].try_cast("int")
    y = p["y"].try_cast("int")
    as_is = F.struct(p["d"].alias("d"), p["m"].alias("m"), p["y"].alias("y"))

    def order(day: str, month: str, year: str) -> Column:
        return F.struct(p[day].alias("d"), p[month].alias("m"), p[year].alias("y"))

    year_leads = (d > 31) & (F.length(p["y"]) == 2)
    numeric = (
        F.when(year_leads & (y <= 12), order("m", "y", "d"))
        .when(year_leads, order("y", "m", "d"))
        .when((d > 12) | (m <= 12), as_is)
        .otherwise(order("m", "d", "y")))
    return (
        F.when(p["kind"] == "numeric", numeric)
        .when(p["kind"] == "year_first", F.when(d <= 12, order("m", "d", "y")).otherwise(as_is))
        .when(year_leads, order("y", "m", "d"))
        .otherwise(as_is)
    )


def _day(p: Column) -> Column:
    year = p["y"].try_cast("int")
    full = F.when(F.length(p["y"]) <= 2, F.when(year < 70, year + 2000).otherwise(year + 1900)) \
        .otherwise(year)
    text = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(p["m"], 2, "0"),
                       F.lpad(p["d"], 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def read_date(raw: Column) -> Column:
    """struct(ok, day): whether a date-shaped text is a date, and which one.

    A month without a day is a date whose day is unknown.
    """

    def settle(p: Column) -> Column:
        n = F.length(p["d"])
        clock = ((F.substring(p["d"], 1, 2) < "24") & (F.substring(p["d"], 3, 2) < "60")
                 & (F.substring(p["d"], 5, 2) < "60"))
        undated = (p["kind"] == "month_only") & (n.isin(3, 4) | ((n == 6) & clock))
        day = F.when(p["kind"] != "month_only", let(_ordered(p), _day))
        return let(day, lambda v: F.struct(
            F.coalesce(v.isNotNull() | undated, F.lit(False)).alias("ok"), v.alias("day")))

    return let(let(clean_date(raw), _parts), settle)


def date_role_of(text: Column) -> Column:
    return (
        F.when(found(text, P.MFG_WORDS), "manufacturing")
        .when(found(text, P.EXP_WORDS), "best_before_use_by")
        .otherwise("unclear")
    )


def role_before(prefix: Column) -> Column:
    """Role of the keyword that starts last in the text before a date."""
    m = F.regexp_instr(prefix, F.lit(P.MFG_WORDS))
    e = F.regexp_instr(prefix, F.lit(P.EXP_WORDS))
    return (
        F.when((m > 0) & (m > e), "manufacturing")
        .when(e > 0, "best_before_use_by")
    )


def phone_fragment(line: Column, date_text: Column) -> Column:
    squeezed = F.regexp_replace(line, r"(?U)\s+", "")
    return found(line, P.PHONE_LIKE) & F.contains(squeezed, date_text)


def date_matches(text: Column) -> Column:
    """array<struct(i, raw, prefix)>: every date shape with the text before it."""
    both = F.struct(matches(text, P.DATE_SHAPE, 1).alias("hits"),
                    F.split(text, P.DATE_SHAPE, -1).alias("gaps"))

    def rows(b: Column) -> Column:
        def prefix(i: Column) -> Column:
            before = F.zip_with(
                F.slice(b["gaps"], F.lit(1), i), F.slice(b["hits"], F.lit(1), i),
                lambda g, h: F.concat(g, h))
            whole = F.concat(F.array_join(before, ""), F.get(b["gaps"], i))
            return F.right(whole, F.lit(P.ROLE_LOOKBEHIND))

        return F.transform(b["hits"], lambda h, i: F.struct(
            i.alias("i"), h.alias("raw"), prefix(i).alias("prefix")))

    return let(both, rows)


def duration_in(text: Column) -> Column:
    """'6 months' for the first shelf life named in the text, else NULL."""

    def read(clean: Column) -> Column:
        number = F.regexp_extract(clean, P.DURATION_VALUE, 1)
        digits = F.coalesce(F.element_at(_literal_map(P.NUMBER_WORDS), F.lower(number)), number)
        return F.when(clean.rlike(P.DURATION_VALUE),
                      F.concat_ws(" ", digits, F.regexp_extract(clean, P.DURATION_VALUE, 2)))

    # dropping repeats never makes or breaks a match, it only tidies the words
    return F.when(text.rlike(P.DURATION_VALUE), let(collapse_repeats(text), read))


# --- contact ----------------------------------------------------------------
def email_in(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), group(text, P.EMAIL, 0))


def phone_by_shape(text: Column) -> Column:
    """A phone-shaped number on a line that makes no other declaration."""
    shapes = F.coalesce(*[group(text, shape, 1) for shape in P.PHONE_SHAPES])
    return F.when(has_digit(text), let(shapes, lambda n: F.when(
        n.isNotNull() & ~found(text, P.NOT_PHONE_LINE), n)))


# --- origin -----------------------------------------------------------------
def clean_origin(value: Column) -> Column:
    """Cut a country name off the declaration that follows it on the line."""

    def cut(whole: Column) -> Column:
        head = F.get(F.split(whole, P.ORIGIN_NEXT_DECLARATION, 2), F.lit(0))
        head = F.get(F.split(head, P.ORIGIN_BREAK, 2), F.lit(0))
        return let(F.btrim(head, F.lit(" .,;:-|")), lambda s: F.when(
            (s == "") | (F.length(s) > P.COUNTRY_LENGTH), whole).otherwise(s))

    return let(strip_space(value), cut)


def is_india(value: Column) -> Column:
    low = F.lower(strip_space(value))
    return F.regexp_replace(low, "[^a-z]", "").isin(P.INDIA_NAMES) | low.isin(P.INDIA_NAMES)


# --- labels and boxes -------------------------------------------------------
def field_label(field: Column) -> Column:
    """Display label: separators to blanks, first letter of each word raised."""
    words = F.split(F.regexp_replace(field, "[_-]", " "), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))),
        " ",
    )


def status_label(status: Column) -> Column:
    names = {"COMPLIANT": "Compliant", "NON_COMPLIANT": "Non-Compliant", "WARNING": "Review Needed"}
    return F.coalesce(F.element_at(_literal_map(names), status), status)


def rule_code(code: Column) -> Column:
    flat = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")
    return F.regexp_replace(flat, r"R0*(\d+)", "R$1")


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    numbers = (x0 >= 0) & (y0 >= 0) & (x1 >= 0) & (y1 >= 0) \
        & ~F.isnan(x0) & ~F.isnan(y0) & ~F.isnan(x1) & ~F.isnan(y1)
    return F.coalesce(numbers & ~((x0 == x1) & (y0 == y1)), F.lit(False))


def percent_box(x0, y0, x1, y1, width, height) -> Column:
    """Box as percentages of the image: ordered, clamped, two pixels at least."""

    def clamp(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v.cast("double"), top.cast("double")))

    left, right = clamp(F.least(x0, x1), width), clamp(F.greatest(x0, x1), width)
    top, bottom = clamp(F.least(y0, y1), height), clamp(F.greatest(y0, y1), height)
    box = F.struct(
        (left / width * 100).alias("left_pct"),
        (top / height * 100).alias("top_pct"),
        (F.greatest(F.lit(2.0), right - left) / width * 100).alias("width_pct"),
        (F.greatest(F.lit(2.0), bottom - top) / height * 100).alias("height_pct"),
    )
    return F.when(valid_box(x0, y0, x1, y1) & (width > 0) & (height > 0), box)


def iou(a: Column, b: Column) -> Column:
    inter = _overlap_area(a, b)
    union = _area(a) + _area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    inter = _overlap_area(a, b)
    smaller = F.least(_area(a), _area(b))
    return F.when((inter > 0) & (smaller > 0), inter / smaller).otherwise(0.0)


def _area(b: Column) -> Column:
    return ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).cast("double")


def _overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), (w * h).cast("double")).otherwise(0.0)
