"""Secret scans in DataFrame operations: fixed patterns, and windows of high entropy.

Base kinds are patterns. The method's kinds look at candidates, runs of a
character class (hexadecimal digits that no letter or digit touches, base64
letters; signs end the first, so NAME=HEX is judged by both limits): a window of WINDOW
characters slides over a candidate while the counts of its characters, and the
sum of c*log2(c) over them, are changed by the one character that enters and the
one that leaves. Shannon entropy is log2(WINDOW) less that sum over WINDOW; the
span from the first to the last window of at least the class's entropy is
reported, unless the candidate or what stands before it is on the allow-list.
Entries of the list that may stand inside a candidate (sample words, counting
digits, one character over and over) cut it: windows they touch don't count, the
parts before and behind are judged by themselves. Sums are whole numbers
(millionths), so they don't drift.

Places are code points, ends exclusive. They come from cutting a text at its
matches: match k begins where the pieces and matches before it end.

Results for odd input: null and empty texts have no spans; equal rows have equal
spans; very long candidates, and texts of many matches, take time in proportion
to their length (no pattern starts over within a candidate or repeats a group by
recursion, and matches are placed in blocks of BLOCK);
an empty table gives no rows. Columns of `docs` that clash with a result's name
are replaced, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in the order of the report.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

WINDOW = 20
#: Class, candidates, alphabet, least entropy of a window, what a candidate must hold besides.
CLASSES = (
    ("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9])", "0123456789abcdef", 3.0, ("[0-9]", "[A-Fa-f]")),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7,
     ("[0-9]", "[A-Za-z]", "[G-Zg-z+/_=-]")),
)
#: Candidates that are no secrets, what cuts a candidate, and what may stand before a value that is none.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9_=-]+$", r"^[a-z]++(?:[-_/][a-z]++)*+[-_/=]?[0-9]{1,4}$",
)
ALLOWED_WITHIN = r"(?i)example|0123456789|abcdefghij|(.)\1{7,}+"
ALLOWED_BEFORE = r"(?i)(sha-?[0-9]{1,3}|md5|commit|digest|checksum|etag)[\"' :=-]{0,4}$"
#: Matches that are placed one after the other before their block is put away.
BLOCK = 256
MILLION = 1_000_000
WEIGHTS = [round(MILLION * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def _let(value: Column, use) -> Column:
    """An expression of a value that is worked out once, however often a lambda below names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, state: Column, step, emptied: Column) -> Column:
    """array of what `step(state, item)` emits (its fields `next` and `out`): a fold whose output isn't copied for every item.

    Items are folded in blocks of BLOCK; only finished blocks are carried along.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))

    def one(a, item):
        return _let(step(a["at"], item), lambda r: F.struct(r["next"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))

    def block(a, b):
        part = F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), F.struct(a["at"].alias("at"), emptied.alias("out")), one)
        return _let(part, lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))

    return F.flatten(F.aggregate(blocks, F.struct(state.alias("at"), F.filter(F.array(emptied), lambda x: F.lit(False)).alias("out")), block)["out"])


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (start, end, whole, value, before): all matches of a pattern, a group's value and the piece before."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def placed(p):
        empty = F.expr("cast(array() as array<struct<start:int,end:int,whole:string,value:string,before:string>>)")

        def step(at, k):
            start = at + F.length(F.get(p["gaps"], k))
            end = start + F.length(F.get(p["whole"], k))
            one = F.struct(start.alias("start"), end.alias("end"), F.get(p["whole"], k).alias("whole"),
                           F.get(p["value"], k).alias("value"), F.get(p["gaps"], k).alias("before"))
            return F.struct(end.alias("next"), one.alias("out"))

        return _running(F.sequence(F.lit(0), F.size(p["whole"]) - 1), F.lit(0), step, empty)

    return _let(parts, lambda p: F.when(F.size(p["whole"]) > 0, placed(p)))


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")


def _when(test: Column, spans: Column) -> Column:
    return F.coalesce(F.when(test, spans), _none())


def _flagged(candidate: Column, alphabet: str, least: float) -> Column:
    """(first, last) of the windows of at least `least` bits, relative to the candidate; first is null for none."""
    ceiling = math.floor(MILLION * WINDOW * (math.log2(WINDOW) - least))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    folded = F.lower(candidate) if alphabet == alphabet.lower() else candidate
    places = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.call_function(
        "locate", c, F.lit(alphabet)) - 1)

    def slide(letters):
        def step(a, i):
            new = F.get(letters, i)
            old = F.coalesce(F.get(letters, i - WINDOW), F.lit(-1))
            counts = a["counts"]
            up, down = F.get(counts, new), F.coalesce(F.get(counts, old), F.lit(0))
            same = new == old
            total = F.when(same, a["total"]).otherwise(
                a["total"] + F.get(weights, up + 1) - F.get(weights, up)
                - F.when(down > 0, F.get(weights, down) - F.get(weights, down - 1)).otherwise(0))
            changed = F.when(same, counts).otherwise(F.transform(
                counts, lambda c, k: c + F.when(k == new, 1).when(k == old, -1).otherwise(0)))
            high = (i >= WINDOW - 1) & (total <= ceiling)
            return F.struct(
                changed.alias("counts"), total.alias("total"),
                F.when(a["first"].isNull() & high, i - WINDOW + 1).otherwise(a["first"]).alias("first"),
                F.when(high, i + 1).otherwise(a["last"]).alias("last"))

        start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("total"),
                         F.lit(None).cast("int").alias("first"), F.lit(0).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step,
                           lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return _let(places, slide)


def _holds(candidate: Column, classes: tuple[str, ...]) -> Column:
    """Whether a character of each class is there: one pass for each."""
    out = F.lit(True)
    for letters in classes:
        out = out & candidate.rlike(letters)
    return out


def _entropy(text: Column, kind: str, pattern: str, alphabet: str, least: float, holds: tuple[str, ...], rank: int) -> Column:
    allowed = lambda m: F.coalesce(m["before"].rlike(ALLOWED_BEFORE), F.lit(False))
    suspects = F.filter(_matches(text, pattern), lambda m: _holds(m["whole"], holds) & ~allowed(m) & ~_any(m["whole"]))
    # most candidates are one part; others are cut at what the allow-list has inside them
    uncut = lambda m: F.array(F.struct(m["start"].alias("at"), m["whole"].alias("part")))
    parts = F.flatten(F.transform(suspects, lambda m: F.when(m["whole"].rlike(ALLOWED_WITHIN), _cut(m)).otherwise(uncut(m))))
    long = F.filter(parts, lambda x: (F.length(x["part"]) >= WINDOW) & _holds(x["part"], holds))
    windows = F.transform(long, lambda x: F.struct(x["at"].alias("at"), _flagged(x["part"], alphabet, least).alias("w")))
    return F.transform(F.filter(windows, lambda x: x["w"]["first"].isNotNull()), lambda x: F.struct(
        (x["at"] + x["w"]["first"]).alias("start"), F.lit(rank).alias("rank"),
        (x["at"] + x["w"]["last"]).alias("end"), F.lit(kind).alias("kind")))


def _cut(m: Column) -> Column:
    """array of (at, part): what a candidate has between entries of the allow-list, with places in the text."""
    within = F.struct(F.split(m["whole"], ALLOWED_WITHIN, -1).alias("parts"),
                      F.regexp_extract_all(m["whole"], F.lit(ALLOWED_WITHIN), F.lit(0)).alias("marks"))

    def placed(p):
        def step(at, k):
            part = F.get(p["parts"], k)
            after = at + F.length(part) + F.coalesce(F.length(F.get(p["marks"], k)), F.lit(0))
            return F.struct(after.alias("next"), F.struct(at.alias("at"), part.alias("part")).alias("out"))

        return _running(F.sequence(F.lit(0), F.size(p["parts"]) - 1), m["start"], step,
                        F.expr("cast(array() as array<struct<at:int,part:string>>)"))

    return _let(within, placed)


def _any(candidate: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | candidate.rlike(pattern)
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, `base` and `spans`: arrays of (start, rank, end, kind) in order of start and kind.

    Cheap tests come first, so that most texts are searched once for each kind and not cut up.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base", "spans", "_base", "_more")])
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_matches(whole, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE)
    access = F.filter(_matches(whole, ACCESS), lambda m: F.length(m["whole"]) >= ACCESS_LENGTH)
    # a run of hexadecimal digits is a match as a whole, so only long ones need be cut out
    long_hex = HEX.replace("+", f"{{{HEX_LENGTH},}}")
    base = F.concat(
        _when((whole.contains("=") | whole.contains(":")) & whole.rlike(ASSIGN), _spans(assign, "assign", 0)),
        _when(whole.contains("AKIA"), _spans(access, "access", 1)),
        _when(whole.rlike(long_hex), _spans(_matches(whole, long_hex), "hex", 2)))
    more = F.concat(*[
        _when(whole.rlike(pattern), _entropy(whole, kind, pattern, alphabet, least, holds, rank))
        for rank, (kind, pattern, alphabet, least, holds) in enumerate(CLASSES, 3)])
    return docs.select("*", base.alias("_base"), more.alias("_more")).select(
        *docs.columns, F.array_sort("_base").alias("base"), F.array_sort(F.concat("_base", "_more")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(scanned: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """All columns of a scan, with every span (overlapping ones together) replaced by a mark."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def step(at, s):
        kept = F.when(s["start"] >= at, F.concat(F.substring(whole, at + 1, s["start"] - at), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(at, s["end"]).alias("next"), kept.alias("out"))

    pieces = _running(F.col("spans"), F.lit(0), step, F.expr("cast(array() as array<string>)"))
    rest = F.substring(whole, F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(whole))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text)))
