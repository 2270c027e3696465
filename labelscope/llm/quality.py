"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

Statistics are DataFrame expressions over whole texts. Learning is sequential
covering on a bounded sample of labelled rows (SAMPLE): a rule is grown from
threshold conditions by information gain on two thirds of the rows, pruned on
the last third, and kept if it is right often enough there; the rows it covers
go, and the next rule is grown. The rules come out in order and are applied as
one chain of `when`; the first that holds rejects the document, none keeps it.

Results for odd input: a null or empty text has no words and zeros throughout;
it fails the base rules. Rows that repeat get a row each. Labels: null labels
are left out, and a document labelled twice counts as bad if either says so; no
labels, or one class only, give an empty list, which keeps what the base rules
keep. Empty tables give no rows. A column of `docs` with the name of a statistic
is replaced; all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import materialize

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
GRAM = 8
#: Labelled rows that a list is fitted on, at most; chosen by a hash of the id.
SAMPLE = 6_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHERS = ("n_lines", "n_upper", "n_stops")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "stop_share", "line_words")


def _removed(text: Column, pattern: str) -> Column:
    """Characters that a pattern takes out of a text."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, STATISTICS and OTHERS (long).

    Repeated words are those inside windows of eight words that occur twice or
    more in the text. Window hashes that are all different, as in most texts,
    need no more; otherwise they are sorted with their places to find equal
    neighbours, and the places' windows are merged.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in STATISTICS + OTHERS])
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, BLANK, -1), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("repeated")))
    by_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))
    return docs.select("*", by_words.alias("_w"), by_lines.alias("_l")).select(
        *docs.columns, F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"),
        _removed(whole, SYMBOLS).cast("long").alias("n_symbols"), F.col("_l.dups").alias("n_dup_lines"),
        F.col("_w.repeated").alias("n_repeat_words"), F.col("_l.n").alias("n_lines"),
        _removed(whole, "[A-Z]+").cast("long").alias("n_upper"), _removed(whole, r"[.!?]+").cast("long").alias("n_stops"))


def _let(value: Column, use) -> Column:
    """An expression of a value that is worked out once, however often a lambda below names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words of an array inside windows of GRAM words that occur twice or more."""
    grams = F.when(F.size(words) >= GRAM, F.transform(
        F.sequence(F.lit(1), F.size(words) - GRAM + 1), lambda i: F.xxhash64(F.slice(words, i, GRAM))))

    def places(ordered):
        same = lambda k: F.coalesce(F.get(ordered, k)["g"] == F.get(ordered, k + 1)["g"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: same(k) | same(k - 1))
        return F.array_sort(F.transform(twice, lambda k: F.get(ordered, k)["i"]))

    def merged(starts):
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["total"] + F.least(F.lit(GRAM), i + GRAM - a["end"])).alias("total"), (i + GRAM).alias("end")),
            lambda a: a["total"])

    return F.coalesce(_let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), merged(_let(
        F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), places)))), F.lit(0).cast("long"))


def features(stats: DataFrame) -> DataFrame:
    """Shares and means, as doubles, beside the statistics they come from; a quotient by zero is zero."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return stats.withColumns({
        "mean_word": over("word_chars", "n_words"), "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"), "repeat_share": over("n_repeat_words", "n_words"),
        "upper_share": over("n_upper", "word_chars"), "stop_share": over("n_stops", "word_chars"),
        "line_words": over("n_words", "n_lines")})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) > self.limit if self.above else F.col(self.feature) <= self.limit

    def holds(self, values):
        x = values[:, FEATURES.index(self.feature)]
        return x > self.limit if self.above else x <= self.limit


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def holds(self, values):
        import numpy as np

        out = np.ones(len(values), bool)
        for c in self.conditions:
            out &= c.holds(values)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.limit:.6g}" for c in self.conditions)


def _best(x, bad) -> tuple[float, float, bool]:
    """Score, limit and side of the best threshold on one feature.

    The score is the information gain for bad rows, a little more for a limit in a wide gap between values.
    """
    import numpy as np

    order = np.argsort(x, kind="stable")
    x, bad = x[order], bad[order]
    cuts = np.flatnonzero(np.diff(x) > 0)
    if not len(cuts):
        return 0.0, 0.0, True
    total, rows = bad.sum(), len(x)
    below = np.cumsum(bad)[cuts].astype(float)
    best = (0.0, 0.0, True)
    for above, p, n in ((False, below, cuts + 1.0), (True, total - below, rows - cuts - 1.0)):
        gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - np.log2(total / rows)), 0.0)
        score = gain * (1 + 0.1 * (x[cuts + 1] - x[cuts]) / (x[-1] - x[0]))
        k = int(np.argmax(score))
        if score[k] > best[0] + 1e-9:
            best = (float(score[k]), float((x[cuts[k]] + x[cuts[k] + 1]) / 2), above)
    return best


def _grown(values, bad, most: int) -> list[Condition]:
    """Conditions added one by one while they gain information on bad rows and good rows are left."""
    import numpy as np

    inside, chosen = np.ones(len(values), bool), []
    while len(chosen) < most and (inside & bad).any() and (inside & ~bad).any():
        score, limit, above, feature = max(
            ((*_best(values[inside, k], bad[inside]), f) for k, f in enumerate(FEATURES)), key=lambda b: b[0])
        if score <= 0:
            break
        chosen.append(Condition(feature, above, limit))
        inside &= chosen[-1].holds(values)
    return chosen


def learn(values, bad, precision: float = 0.9, most: int = 4, rules: int = 12) -> list[Rule]:
    """Ordered rules for bad rows. values: a row of FEATURES for each row; bad: booleans.

    Rows alternate, in the order given, between two thirds for growing and one
    for pruning. Learning ends with the first rule that is right less often than
    `precision` on pruning rows, or covers fewer than three bad ones of all rows.
    """
    import numpy as np

    values, bad = np.asarray(values, float).reshape(-1, len(FEATURES)), np.asarray(bad, bool)
    turn, found = np.arange(len(bad)) % 3, []
    while len(found) < rules and bad.any() and not bad.all():
        grow, prune = turn < 2, turn == 2
        conditions = _grown(values[grow], bad[grow], most)
        if not conditions:
            break

        def worth(k):
            covered = Rule(tuple(conditions[:k])).holds(values[prune])
            p, n = (covered & bad[prune]).sum(), (covered & ~bad[prune]).sum()
            return (p - n) / (p + n) if p + n else -1.0, -k

        rule = Rule(tuple(conditions[:max(range(1, len(conditions) + 1), key=worth)]))
        covered = rule.holds(values)
        right = covered & bad
        if (right & prune).sum() < precision * (covered & prune).sum() or right.sum() < max(3, precision * covered.sum()):
            break
        found.append(rule)
        values, bad, turn = values[~covered], bad[~covered], turn[~covered]
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, precision: float = 0.9) -> list[Rule]:
    """Rules from at most `sample` labelled documents; only their texts are read into statistics.

    Rows that fail the base rules are rejected without the list, so it is learned from the others.
    """
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    rows = materialize(features(statistics(texts)).select("doc_id", *STATISTICS, *FEATURES[1:], "quality")).filter(~base_failed())
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    return learn(table[list(FEATURES)].to_numpy(), table["quality"].to_numpy() == 0, precision)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, or null."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), 1)
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), k)
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns of `docs`, the statistics, base_failed, rule and kept."""
    keep = [c for c in docs.columns if c.lower() not in STATISTICS + OTHERS + ("base_failed", "rule", "kept")]
    rated = features(statistics(docs.select(*keep)))
    failed = F.coalesce(base_failed(), F.lit(True))
    out = rated.withColumns({"base_failed": failed, "rule": verdict(rules)})
    return out.select(*keep, *STATISTICS, *OTHERS, "base_failed", "rule",
                      (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
