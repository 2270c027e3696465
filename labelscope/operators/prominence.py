"""Third-tier common names: rank phrases by how prominently they are set.

Every measure is relative to the scan (body height, page extent), so it holds
at any resolution. Names found here are read off the typography and marked as
inferred.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators.evidence import candidates, rank
from labelscope.operators.sequence import BOX, positions
from labelscope.operators.sweep import swept
from labelscope.operators.tables import readable
from labelscope.operators.vocabulary import count_descriptors
from labelscope.options import DEFAULT, Options
from labelscope.session import materialize

PAGE = ["scan_id", "image_index"]


def _height(y0: Column, y1: Column) -> Column:
    return F.greatest(F.lit(1.0), (y1 - y0).cast("double"))


class Phrase:
    """The phrase a sweep is in: grown by each line that joins it, given away when one doesn't."""

    def __init__(self):
        self._made, self._texts = 0, None

    def add(self, y0, x0, pos, text, x1, y1, confidence):
        if self._texts is not None:
            top, left, right, low = self._box
            high, own = max(1.0, low - top), max(1.0, y1 - y0)
            joins = (abs(high - own) <= P.JOIN_HEIGHT_TOLERANCE * max(high, own)
                     and -own <= y0 - low <= P.JOIN_GAP_RATIO * min(high, own) and min(right, x1) > max(left, x0))
            if joins:
                self._box = min(top, y0), min(left, x0), max(right, x1), max(low, y1)
                self._texts.append(text)
                if self._confidence is None or confidence is None:
                    self._confidence = confidence if self._confidence is None else self._confidence
                else:  # thousandths of the printed digits, half to even, as elsewhere
                    mean = Decimal(repr((self._confidence + confidence) / 2))
                    self._confidence = float(mean.quantize(Decimal("0.001"), ROUND_HALF_EVEN))
                return
            yield from self.end()
        self._pos, self._texts, self._confidence, self._box = pos, [text], confidence, (y0, x0, x1, y1)

    def end(self):
        if self._texts is not None:
            top, left, right, low = self._box
            yield self._made, top, left, self._pos, " ".join(self._texts), right, low, self._confidence
            self._made += 1


def phrases(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Lines joined into phrases: same size, close below, overlapping, one image.

    The phrase grows while it is compared, so lines are swept from top to bottom;
    all that is held is the phrase the sweep is in.
    """
    legible = lines.filter((T.trimmed(F.col("text")) != "") & readable(F.col("confidence"), options))
    item = legible.select(
        *PAGE, *[F.col(c).cast("double").alias(c) for c in ("y0", "x0")], "pos", "text",
        *[F.col(c).cast("double").alias(c) for c in ("x1", "y1")], F.col("confidence").cast("double").alias("confidence"))
    rows = materialize(swept(item, PAGE, ["y0", "x0", "pos"], Phrase,
                 "i bigint, y0 double, x0 double, pos bigint, text string, x1 double, y1 double, confidence double"))
    return positions(rows.withColumn("stretch", F.lit(0)), ["image_index", "stretch", "i"], "idx").drop("stretch", "i")


def nth_smallest(rows: DataFrame, keys: list[str], value: str, place: Column, out: str) -> DataFrame:
    """keys, `out`: the value at a 0-based place of each group's sorted values; `place` is an expression of the group's size `n`.

    Exact at any size: values are counted before the shuffle, and what is
    ordered is the histogram, a row for each different value.
    """
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n")).withColumn("_upto", upto).withColumn("n", F.sum("_n").over(group))
    return counted.filter(F.col("_upto") > place).groupBy(*keys).agg(F.min(value).alias(out))


def rank_phrases(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Scored name candidates with their feature values; hard exclusions removed."""
    joined = materialize(phrases(lines, options).withColumn("h", _height(F.col("y0"), F.col("y1"))))
    text = F.col("text")
    page = joined.groupBy(*PAGE).agg(
        F.count("*").alias("n_page"),
        F.max("h").alias("tallest"),
        F.count_if(T.found(text, P.NOT_A_NAME)).alias("regulatory"),
        F.min("x0").alias("px0"), F.min("y0").alias("py0"),
        F.max("x1").alias("px1"), F.max("y1").alias("py1"),
    ).join(nth_smallest(joined, PAGE, "h", F.floor(F.col("n") / 2), "middle"), PAGE).withColumn("front", F.col("tallest") / F.col("middle") * (1 - F.col("regulatory") / F.col("n_page")))
    top = Window.partitionBy("scan_id")  # one row per image
    page = page.withColumn("best_front", F.max("front").over(top)).withColumn(
        "panel", F.when(F.col("best_front") > 0, F.col("front") / F.col("best_front")).otherwise(F.col("front")))
    several = joined.groupBy("scan_id").agg(F.count("*").alias("n")).filter("n >= 2")
    body = nth_smallest(joined, ["scan_id"], "h", F.floor(F.col("n") / 4), "body").join(several, "scan_id")
    repeats = joined.groupBy("scan_id", T.name_key(text).alias("name_key")).agg(F.count("*").alias("repeats"))

    value = F.btrim(text, F.lit(" .,:-"))
    conf = F.coalesce("confidence", F.lit(0.0))
    solid = F.replace(F.col("value"), F.lit(" "), F.lit(""))
    words = F.filter(F.split(F.col("value"), r"(?U)\s+"), lambda w: w != "")
    n_letters = F.length(F.regexp_replace(F.col("value"), r"[^\p{L}]", ""))
    label = F.lit(False)
    for pattern in P.TABLE_LABELS:
        label = label | T.found(F.col("value"), pattern)
    allowed = (
        F.length("value").between(*P.NAME_LENGTH) & (F.col("conf") >= P.NAME_CONFIDENCE) & ~label
        & ~T.found(F.col("value"), P.NOT_A_NAME) & ~T.found(F.col("value"), P.INSTRUCTION)
        & ~F.forall(words, lambda w: w.rlike(P.CODE_TOKEN))
        & (n_letters >= F.greatest(F.lit(P.NAME_LENGTH[0]), F.length(solid) * 0.5))
        & (F.col("ratio") >= P.PROMINENCE_RATIO)
    )
    kept = materialize(
        joined.withColumn("value", value).withColumn("conf", conf).withColumn("name_key", T.name_key(text))
        .join(body, "scan_id").withColumn("ratio", F.col("h") / F.col("body")).filter(allowed)
        .join(page, PAGE).join(repeats, ["scan_id", "name_key"])
    )
    described = count_descriptors(kept, ["scan_id", "idx"], F.col("value"), options)
    scored = kept.join(described, ["scan_id", "idx"], "left").withColumn(
        "descriptors", F.coalesce("score", F.lit(0))).drop("score")
    marketing = T.found(F.col("value"), P.MARKETING)
    x_mid = ((F.col("x0") + F.col("x1")) / 2 - F.col("px0")) / F.greatest(F.lit(1.0), F.col("px1") - F.col("px0"))
    y_mid = ((F.col("y0") + F.col("y1")) / 2 - F.col("py0")) / F.greatest(F.lit(1.0), F.col("py1") - F.col("py0"))
    n_words = F.greatest(F.lit(1), F.size(words))
    n_solid = F.greatest(F.lit(1), F.length(solid))
    one = F.lit(1.0)
    features = {
        "font": F.least(F.col("ratio") / 3.0, one),
        "position": F.greatest(F.lit(0.0), (1 - F.abs(x_mid - 0.5) * 2) * 0.7 + (1 - F.abs(y_mid - 0.4)) * 0.3),
        "confidence_score": F.col("conf"),
        "semantic": F.least(one, F.col("descriptors") / 2.0),
        "length": 1.0 - F.least(one, F.abs(F.size(words) - 2.5) / 4.0),
        "front_panel": F.col("panel"),
        "repeat": F.when(F.col("repeats") > 1, 1.0).otherwise(0.0),
        "numeric": F.length(F.regexp_replace(solid, r"[^\p{Nd}]", "")) / n_solid,
        "symbol": F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]", "")) / n_solid,
        "sentence": F.least(one, F.size(T.matches(F.col("value"), P.SENTENCE_WORD)) / n_words * 2),
        "ingredient": F.least(one, F.length(F.regexp_replace(F.col("value"), "[^,]", "")) / 3.0),
        "marketing": F.when(marketing, 1.0).otherwise(0.0),
    }
    weight, penalty = P.PROMINENCE_WEIGHTS, P.PROMINENCE_PENALTIES
    f = F.col
    total = (
        weight["font"] * f("font") + weight["position"] * f("position")
        + weight["confidence"] * f("confidence_score") + weight["semantic"] * f("semantic")
        + weight["length"] * f("length") + weight["panel"] * f("front_panel")
        + weight["repeat"] * f("repeat")
        - penalty["numeric"] * f("numeric") - penalty["symbol"] * f("symbol")
        - penalty["sentence"] * f("sentence") - penalty["ingredient"] * f("ingredient")
        - penalty["marketing"] * f("marketing")
    )
    return (
        scored.filter(~(marketing & (F.col("descriptors") == 0)))
        .withColumns(features)
        .withColumn("final_score", F.bround(total, 3))
        .select("scan_id", "idx", "image_index", "text", "value", "confidence", *BOX,
                "final_score", "descriptors", F.bround("ratio", 2).alias("prominence_ratio"),
                *features)
    )


def pick_names(ranked: DataFrame) -> DataFrame:
    """Leader per scan, unless a phrase that names a commodity comes close."""
    entry = F.struct("final_score", (-F.col("idx")).alias("o"), "idx", "image_index", "text", "value",
                     "confidence", *BOX, "descriptors", "prominence_ratio")
    best = ranked.groupBy("scan_id").agg(
        F.max(entry).alias("leader"),
        F.max(F.when(F.col("descriptors") > 0, entry)).alias("named"))
    close = (F.col("leader.descriptors") == 0) & (
        F.col("named.final_score") >= F.col("leader.final_score") * 0.5)
    return (
        best.select("scan_id", F.when(F.coalesce(close, F.lit(False)), F.col("named"))
                    .otherwise(F.col("leader")).alias("n"))
        .select("scan_id", "n.*").filter(F.col("final_score") >= P.NAME_SCORE)
    )


def prominent_names(ready: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Common-name candidates of the third tier, one per scan at most."""
    names = materialize(pick_names(rank_phrases(ready, options)))
    around = ready.select("scan_id", F.col("pos").alias("idx"), F.col("ctx2"))
    rows = names.join(around, ["scan_id", "idx"], "left")
    return candidates(
        rows, "'common_name'", rank("4", "idx"), raw_text=F.col("text"),
        context=F.col("ctx2"), match_method=F.lit("visual_prominence"), partial=F.lit(True),
        inferred=F.lit(True), name_score=F.col("final_score"))
