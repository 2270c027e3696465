"""Surrogates for personal data: keyed replacements of the same type, form, script and gender.

Entities are found by pattern, and reduced to units that are replaced as wholes
wherever they occur: an email address in lower case, the digits of a phone or
card number, an IPv4 address, a first name (with the gender of the title before
it), a family name. A unit's surrogate is drawn from HMAC-SHA256 of (key, type,
unit, attempt): letters become letters of the same alphabet or script, digits digits,
names come from lists of the same script and gender, valid card numbers stay
valid, addresses stay addresses of the same range. Each mention is written in
its own form: its spaces, signs and capitals.

Phone numbers have separators between groups, or are digits after a plus sign or
a bracketed or slashed area code. Bare digits without any sign are left: they
can't be told from other numbers.

Distinctness: units of the whole table are compared in Spark. A surrogate that
equals a unit of its type found in the texts, or the surrogate of a smaller
unit, is drawn again with the next attempt, until all differ; so different
people stay different, equal ones equal in all documents, and no surrogate
points at anyone real in the table. Where a form has few free values or none
(all addresses of a private range, an email address of one sign), every WIDEN
attempts widen it: a letter or digit more, or an address of the reserved range
240.0.0.0/4. So drawing ends however dense the units are.

Results for odd input: null and empty texts stay as they are, with no entities;
rows that repeat or share a doc_id get a row each; an empty table gives no rows;
columns of `docs` that clash with a result's name are replaced, all others stay.
A unit that very many documents share is one row of the mapping; its mentions
are joined to it by shuffles that adaptive execution can split.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import materialize, small, small_batches

TYPES = ("email", "card", "ip", "phone", "first_f", "first_m", "family")
FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|г-жа|госпожа"
MALE = r"Mr|Herr|Señor|Sr|Monsieur|г-н|господин"
_CAP = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+"
ENTITY = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<card>(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,14}(?:[ ./-]\d{2,10}){0,4}"
    r"|\(\d{1,5}\)[ .-]?\d{1,10}(?:[ .-]\d{2,10}){0,4}"
    r"|(?<![/.])(?:0\d{2,4}/ ?\d{4,10}|0\d/ ?\d{5,10}|\d{3,5}/ ?\d{3}[ .-]?\d{4})(?:[ .-]\d{1,5}){0,3}"
    r"|\d{1,5}(?:[ .-]\d{2,5}){1,4})(?!\w))"
    rf"|(?<!\w)(?:(?P<f>{FEMALE})|(?P<m>{MALE}))\.?\s(?P<name>{_CAP}(?:\s{_CAP})?)")
_DATE = re.compile(r"\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ]\d{2,4}").fullmatch
#: A number with its last groups left out, one after the other.
_SHORTER = re.compile(r"[ ./-]\d+$")
_WORTH = re.compile(rf"[0-9@]|(?:{FEMALE}|{MALE})\.?\s").search

# Name lists by script and gender, beyond which syllables are drawn.
NAMES = {
    ("latin", "first_f"): "Alice Anna Clara Dora Elena Eva Ida Julia Laura Lena Lucia Maria Mina Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("latin", "first_m"): "Adam Anton Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leo Max Noel Oscar Paul Robert Simon Tom Victor".split(),
    ("latin", "family"): "Adler Bauer Costa Duran Engel Ferrer Garnier Holm Ibarra Jansen Keller Lambert Moreau Novak Olsen Perez Rossi Silva Torres Weber".split(),
    ("cyrillic", "first_f"): "Анна Вера Елена Ирина Лидия Мария Нина Ольга Полина София".split(),
    ("cyrillic", "first_m"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Павел Роман".split(),
    ("cyrillic", "family"): "Агапов Белов Волков Громов Данилов Жуков Зимин Котов Орлов Титов".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γο δα δε θα κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ",
             "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_ALPHABET = {c: a for a in ALPHABETS for c in a}
#: Attempts in a form before it is widened.
WIDEN = 6


@functools.lru_cache(1 << 16)
def _others(c: str) -> str:
    """Other letters (or digits) of a letter's script, category and block, as far as a block of 128 or 256 tells; "" for signs."""
    if not c.isalnum():
        return ""
    script, width = unicodedata.name(c, "").split(" ")[0].split("-")[0], 128 if ord(c) < 0x2E80 else 256
    low = ord(c) // width * width
    near = [d for d in map(chr, range(low, low + width))
            if d != c and unicodedata.category(d) == unicodedata.category(c) and unicodedata.name(d, "").split(" ")[0].split("-")[0] == script
            and d.isalnum() and len(d.upper()) == 1 and (d.casefold() == d) == (c.casefold() == c) and unicodedata.normalize("NFC", d) == d]
    return "".join(near) or ALPHABETS[c.isupper()]


def _script(word: str) -> str:
    for c in word:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def entities(text: str) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """Mentions (start, end, units); a unit is (type, its reduced form), a name may have two."""
    out = []
    if not text or not _WORTH(text):
        return out
    at = 0
    while m := ENTITY.search(text, at):
        kind, value, at = m.lastgroup, m[0], m.end()
        if kind == "name":
            words = m["name"].split()
            first = "first_f" if m["f"] else "first_m"
            kinds = ["family"] if len(words) == 1 else [first, "family"]
            out.append((m.start("name"), m.end("name"), [(k, w.casefold()) for k, w in zip(kinds, words)]))
        elif kind in ("card", "phone"):
            if value[0] in "+(":  # numbers that follow a whole phone number are none of its groups
                while sum(map(str.isdigit, value)) > 15 and _SHORTER.search(value):
                    value = _SHORTER.sub("", value)
                at = m.start() + len(value)
            digits = "".join(c for c in value if c.isdigit())
            if kind == "phone" and (not 7 <= len(digits) <= 15 or _DATE(value)):
                continue
            out.append((m.start(), at, [(kind, digits)]))
        else:
            out.append((m.start(), m.end(), [(kind, value.casefold() if kind == "email" else value)]))
    return out


class _Draws:
    """Numbers below given bounds, one after the other, fixed by a seed."""

    def __init__(self, key: bytes, kind: str, unit: str, attempt: int):
        self._seed, self._n, self._pool = (key, f"{kind}\x00{unit}\x00{attempt}".encode()), 0, b""

    def below(self, bound: int) -> int:
        if len(self._pool) < 4:
            self._pool += hmac.new(self._seed[0], self._seed[1] + self._n.to_bytes(4, "big"), hashlib.sha256).digest()
            self._n += 1
        value, self._pool = int.from_bytes(self._pool[:4], "big"), self._pool[4:]
        return value % bound


def _luhn(digits: str) -> int:
    """Check digit of a number without one."""
    return -sum(sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(key: bytes, kind: str, unit: str, attempt: int) -> str:
    """A unit's replacement, in reduced form (names capitalised)."""
    draw = _Draws(key, kind, unit, attempt)
    like = lambda s: "".join(x[draw.below(len(x))] if (x := _ALPHABET.get(c) or _others(c)) else c for c in s)
    wider = attempt // WIDEN
    if kind == "email":
        local, _, domain = unit.rpartition("@")
        host, _, top = domain.rpartition(".")
        reserved = re.search(r"(?:^|\.)(example)$", host)  # a name that can belong to no one stays
        kept = reserved[0] if reserved else ""
        return f"{like(local + wider * 'a')}@{like(host.removesuffix(kept))}{kept}.{top}"
    if kind == "card":
        body = unit[0] + like(unit[1:-1] + wider * "0")
        valid = _luhn(unit[:-1]) == int(unit[-1])
        return body + (str(_luhn(body)) if valid else like(unit[-1]))
    if kind == "phone":
        kept = 1 if len(unit) > 10 else 0  # the country's first digit
        return unit[:kept] + like(unit[kept:] + wider * "0")
    if kind == "ip" and wider:
        return ".".join(map(str, (240 + draw.below(15), draw.below(256), draw.below(256), draw.below(256))))
    if kind == "ip":
        a, *rest = unit.split(".")
        private = {"10": 1, "127": 1, "192": 2 if rest[0] == "168" else 0, "172": 0}.get(a, 0)
        parts = [a, *rest]
        fresh = [str(1 + draw.below(223) if k == 0 else draw.below(256)) for k in range(4)]
        return ".".join(parts[:private] + fresh[private:])
    script = _script(unit)
    listed = NAMES.get((script, kind), [])
    if attempt < 3 and listed:
        name = listed[draw.below(len(listed))]
    else:
        parts = SYLLABLES[script]
        ending = {"first_f": {"latin": "a", "cyrillic": "я", "greek": "α"}, "first_m": {"latin": "n", "cyrillic": "н", "greek": "ς"}}.get(
            kind, {"latin": "r", "cyrillic": "в", "greek": "ς"})[script]
        name = "".join(parts[draw.below(len(parts))] for _ in range(2 + min(attempt // 3, 6))).capitalize() + ending
    if script == "cyrillic" and kind == "family" and unit.endswith(("ова", "ева", "ина")):
        name += "а"
    return name


def _written(mention: str, units: list[tuple[str, str]], found: dict) -> str:
    """A mention with its units replaced, in its own form."""
    kind = units[0][0]
    new = [found[u] for u in units]
    if kind in ("card", "phone"):
        digits = iter(new[0])
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new[0])) if len(mention) == len(new[0]) else new[0]
    if kind == "ip":
        return new[0]
    parts = re.split(r"(\s)", mention)
    names = iter(n.upper() if len(w) > 1 and w.isupper() else n for w, n in zip(parts[::2], new))
    return "".join(next(names) if i % 2 == 0 else x for i, x in enumerate(parts))


def units(docs: DataFrame) -> DataFrame:
    """key (hash of the row), kind and unit: distinct within each row. Input: key, text."""

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(key, *u) for key, text in zip(*(c.to_pylist() for c in batch.columns))
                    for u in {u for _, _, us in entities(text) for u in us}]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["key", "kind", "unit"])

    return small_batches(docs.select("key", "text")).mapInArrow(find, "key long, kind string, unit string")


def mapping(found: DataFrame, key: bytes, rounds: int = 60) -> DataFrame:
    """kind, unit, surrogate for all distinct units, every surrogate different from the others of its kind and from all units."""

    def drawn(attempt: int):
        def draw(batches):
            import pyarrow as pa

            for batch in batches:
                kinds, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                new = [surrogate(key, k, u, attempt) for k, u in zip(kinds, names)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(new, pa.string()), pa.array([x.casefold() for x in new], pa.string())],
                    names=["kind", "unit", "surrogate", "taken"])
        return draw

    everyone = materialize(found.select("kind", "unit").distinct())
    waiting, settled = everyone, None
    for attempt in range(rounds):
        drawn_now = materialize(waiting.mapInArrow(drawn(attempt), "kind string, unit string, surrogate string, taken string"))
        free = drawn_now.join(everyone.select("kind", F.col("unit").alias("taken")), ["kind", "taken"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "taken"), ["kind", "taken"], "left_anti")
        winners = materialize(free.groupBy("kind", "taken").agg(F.min(F.struct("unit", "surrogate")).alias("w")).select(
            "kind", "w.unit", "w.surrogate", "taken"))
        settled = winners if settled is None else settled.unionByName(winners)
        waiting = materialize(drawn_now.join(winners, ["kind", "unit"], "left_anti").select("kind", "unit"))
        if not waiting.limit(1).count():
            return settled.select("kind", "unit", "surrogate")
    raise RuntimeError("surrogates collide: too many units for their form")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of `docs` with personal data in `text` replaced, and n_entities (mentions)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_entities", "key", "_pairs")])
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = materialize(units(keyed))
    named = found.distinct().join(mapping(found, key), ["kind", "unit"])
    pairs = materialize(named.groupBy("key").agg(F.collect_list(F.struct("kind", "unit", "surrogate")).alias("_pairs")))
    joined = keyed.join(small(pairs, 100_000), "key", "left").drop("key")
    kept = [f for f in joined.schema.fields if f.name != "_pairs"]
    where = [f.name for f in kept].index("text")

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts = [], []
            for text, listed in zip(batch.column(where).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                mentions = entities(text) if listed else []
                counts.append(len(mentions))
                if mentions:
                    known, parts, at = {(p["kind"], p["unit"]): p["surrogate"] for p in listed}, [], 0
                    for start, end, us in mentions:
                        parts += [text[at:start], _written(text[start:end], us, known)]
                        at = end
                    text = "".join(parts) + text[at:]
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_entities"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_entities long"])
    return small_batches(joined).mapInArrow(rewrite, schema)
