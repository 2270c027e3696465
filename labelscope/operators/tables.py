"""Two-column declaration tables: find label and value columns, pair, merge.

A block is the legible text of one image run. Most blocks fail a cheap test on
counts or edges, so every step filters blocks before the next one joins. The
greedy pairing by overlap is taken in rounds of claims that are best for both
sides; wrapped values are swept from top to bottom.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.functions import fuzzy
from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators import grid
from labelscope.operators.sequence import BOX, image_runs, oversized_scans, positions
from labelscope.operators.sweep import swept
from labelscope.options import DEFAULT, Options
from labelscope.session import materialize

BLOCK = ["scan_id", "run"]
MERGED_BASE = 1 << 40


def readable(confidence: Column, options: Options = DEFAULT) -> Column:
    if not options.confidence_gating:
        return F.lit(True)
    return confidence.isNull() | (confidence >= P.MIN_VALUE_CONFIDENCE)


def label_sized(text: Column) -> Column:
    return F.length(T.trimmed(text)).between(1, P.TABLE_LABEL_LENGTH)


def exact_label(text: Column) -> Column:
    """Whether a line is a label of any field, as printed."""
    clean = T.trimmed(text)
    exact = F.lit(False)
    for pattern in P.TABLE_LABELS:
        exact = exact | T.found(clean, pattern)
    return label_sized(text) & exact


def garbled_label(text: Column) -> Column:
    """Whether a line is a label with reading errors."""
    return label_sized(text) & (fuzzy.resembles(T.trimmed(text)).bitwiseAND(fuzzy.MAKER | fuzzy.AGENT) > 0)


def _height() -> Column:
    return F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")).cast("double"))


def table_blocks(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Lines of every block that is a clean two-column table, with their side.

    All steps are windows over a block, so its lines are dealt out once and the
    shape of the block is not joined back to them. The result is read from
    written tables.
    """
    block = Window.partitionBy(*BLOCK)
    of = lambda column: column.over(block)
    x0, x1 = F.col("x0"), F.col("x1")
    read = (
        image_runs(lines).filter("own")
        .filter(readable(F.col("confidence"), options) & (T.trimmed(F.col("text")) != ""))
        .drop("own", "chunk")
        .withColumn("h", _height())
        .withColumns({"_n": of(F.count("*")), "_spread": of(F.max("x0")) - of(F.min("x0"))})
    )
    # most blocks end here, as no text is lower than a pixel
    wide = read.filter((F.col("_n") >= 4) & (F.col("_spread") > P.COLUMN_GAP_RATIO))
    upper_median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC) OVER (PARTITION BY scan_id, run)")
    gapped = wide.withColumn("_gap", upper_median * P.COLUMN_GAP_RATIO).filter(F.col("_spread") > F.col("_gap"))
    following = F.lead("x0").over(block.orderBy("x0"))
    split = of(F.min(F.when(F.col("_next") - x0 > F.col("_gap"), F.struct("x0", "_next"))))
    sided = (
        gapped.withColumn("_next", following).withColumn("_split", split).filter("_split is not null")
        .withColumn("is_left", x0 < (F.col("_split.x0") + F.col("_split._next")) / 2.0)
    )
    left, width = F.col("is_left"), x1 - x0
    candidates = (
        sided.withColumns({
            "nl": of(F.count_if(left)), "nr": of(F.count_if(~left)),
            "_right_start": of(F.min(F.when(~left, x0))), "_left_end": of(F.max(F.when(left, x1))),
            "_narrow": of(F.min(F.when(left, width))), "_broad": of(F.max(F.when(left, width)))})
        .filter(
            (F.col("nl") >= 2) & (F.col("nr") >= 2) & (F.col("_right_start") >= F.col("_left_end"))
            & (F.col("_broad") <= P.LABEL_WIDTH_RATIO * F.greatest(F.lit(1), F.col("_narrow"))))
        .drop("_n", "_spread", "_gap", "_next", "_split", "_right_start", "_left_end", "_narrow", "_broad")
    )
    rank = Window.partitionBy(*BLOCK, "is_left").orderBy("y0", "pos")
    label = F.when(left, F.col("text"))
    found = materialize(
        candidates.withColumns({"_exact": exact_label(label), "_sized": label_sized(label)})
        .withColumns({"_clean": of(F.bool_and("_exact")), "_able": of(F.bool_and("_sized"))})
        .filter("_able" if options.fuzzy_labels else "_clean").drop("_sized", "_able")
        .withColumn("rank", F.row_number().over(rank)).withColumn("centre", (F.col("y0") + F.col("y1")) / 2.0))
    clean, doubtful = (found.filter(f"{side} _clean").drop("_clean") for side in ("", "not"))
    if doubtful.isEmpty():
        return clean.drop("_exact")
    # Python is asked for the labels of the other blocks only
    read_wrong = doubtful.withColumn("_known", F.col("_exact") | garbled_label(F.when(left & ~F.col("_exact"), F.col("text"))))
    mended = read_wrong.withColumn("_ok", of(F.bool_and("_known"))).filter("_ok").drop("_known", "_ok")
    return clean.unionByName(materialize(mended)).drop("_exact")


def _side(members: DataFrame, left: bool) -> DataFrame:
    prefix, part = ("l", members.filter("is_left")) if left else ("v", members.filter("not is_left"))
    return part.select(*BLOCK, "nl", "nr", *[F.col(c).alias(f"{prefix}_{c}") for c in ("pos", "rank", "y0", "y1", "centre", "h")])


def pairs_by_row(members: DataFrame) -> DataFrame:
    """Pair labels with the values of their row, then fold wrapped values in.

    Columns: block, l_pos, v_pos, seq. Blocks without row numbers give nothing.
    A value finds the labels of its row by a window, so a block's lines are
    dealt out once.
    """
    block, left = Window.partitionBy(*BLOCK), F.col("is_left")
    label_row = F.when(left, F.col("row_index"))
    rows = (
        members.select(*BLOCK, "pos", "is_left", "rank", "row_index", "column_index", "x0", "x1", "y0", "y1", "h")
        .withColumn("_ok", F.bool_and(F.col("row_index").isNotNull()).over(block)).filter("_ok")
        # the next row below that has a label
        .withColumn("next_row", F.min(label_row).over(
            block.orderBy(F.desc("row_index")).rangeBetween(Window.unboundedPreceding, -1)))
        .withColumn("_labels", F.collect_list(F.when(left, F.struct("pos", "column_index", "rank"))).over(
            Window.partitionBy(*BLOCK, "row_index")))
        .filter(~left)
    )
    column = F.col("column_index")
    beside = F.filter("_labels", lambda l: l["column_index"].isNull() | column.isNull() | (column > l["column_index"]))
    none = F.array(F.lit(None).cast(rows.schema["_labels"].dataType.elementType))
    in_row = Window.partitionBy(*BLOCK, "l_pos").orderBy(F.coalesce("column_index", F.lit(0)), "x0", "pos")
    # a value on a row without labels is loose: it comes once, with no label
    met = (
        rows.withColumn("_l", F.explode(F.when(F.size("_labels") == 0, none).otherwise(beside)))
        .withColumns({"l_pos": F.col("_l.pos"), "_order": -F.col("_l.rank")})
        .withColumns({"seq": F.row_number().over(in_row), "_last": F.lead("pos").over(in_row).isNull(),
                      "_wraps": F.bool_or(F.col("_l").isNull()).over(block)})
    )
    shown = F.col("l_pos").isNull() | (F.col("_last") & F.col("_wraps"))
    double = lambda c: F.col(c).cast("double")
    low, own = F.col("l_pos").isNull(), F.col("row_index")
    met = materialize(met.select(
        *BLOCK, "l_pos", F.col("pos").alias("v_pos"), F.col("seq").cast("bigint").alias("seq"), F.when(shown, F.struct(
            F.when(low, double("y0")).otherwise(double("y1")).alias("at"), low.cast("int").alias("kind"), "pos", "l_pos",
            F.col("_order").cast("bigint").alias("order"), double("y1").alias("y1"), double("x0").alias("x0"), double("x1").alias("x1"), "h",
            F.when(low, own).otherwise(F.col("next_row")).cast("bigint").alias("row"))).alias("event")))
    events = met.filter("event is not null").select(*BLOCK, "event.*")
    folded = swept(events, BLOCK, ["at", "kind", "pos"], Wraps, "l_pos bigint, v_pos bigint, seq bigint")
    return met.filter("l_pos is not null").select(*BLOCK, "l_pos", "v_pos", "seq").unionByName(folded)


class Wraps:
    """Loose values of a block, each given to the pair whose last value ends nearest above it, in reading order.

    Pairs come in when the sweep reaches the bottom of their last value and go
    when no later value can be near enough; a pair that takes a value waits for
    that value's bottom. A label on a row in between keeps a value from its pair.
    """

    def __init__(self):
        self._ready, self._waiting, self._taken = [], [], 0

    def add(self, at, kind, pos, l_pos, order, y1, x0, x1, h, row):
        if kind == 0:
            heapq.heappush(self._waiting, (y1, order, l_pos, x0, x1, h, row))
            return
        while self._waiting and self._waiting[0][0] <= at:
            self._ready.append(heapq.heappop(self._waiting))
        self._ready = [p for p in self._ready if at - p[0] <= P.WRAP_GAP_RATIO * p[5]]
        host = max((p for p in self._ready if min(p[4], x1) > max(p[3], x0)), key=lambda p: p[:3], default=None)
        if host is not None and not (host[6] is not None and row is not None and host[6] < row):
            self._ready.remove(host)
            heapq.heappush(self._waiting, (y1, host[1], host[2], x0, x1, h, host[6]))
            yield host[2], pos, (1 << 32) + self._taken  # behind all direct values
            self._taken += 1

    def end(self):
        return ()


def pairs_by_geometry(members: DataFrame) -> DataFrame:
    """One-to-one pairs by vertical overlap; a block pairs wholly or not at all.

    A value of a small block finds the labels by a window; in other blocks both
    meet in the cells of a grid. `members` is read several times and should be a
    written table.
    """
    block = Window.partitionBy(*BLOCK)
    # each label needs a value of its own, and one value more may be a wrapped one
    members = members.filter((F.col("nr") - F.col("nl")).between(0, 1)).select(
        *BLOCK, "pos", "is_left", "rank", *BOX, "centre", "h", "nl", "nr")
    few = F.col("nl") + F.col("nr") <= grid.FEW
    wanted = ["pos", "rank", "y0", "y1", "centre", "h"]
    met = (
        members.filter(few).withColumn("_labels", F.collect_list(F.when(F.col("is_left"), F.struct(*wanted))).over(block))
        .filter(~F.col("is_left")).withColumn("_l", F.explode("_labels"))
        .select(*BLOCK, "nl", "nr", *[F.col(f"_l.{c}").alias(f"l_{c}") for c in wanted], *[F.col(c).alias(f"v_{c}") for c in wanted]))
    if not members.filter(~few).isEmpty():
        left, right = _side(members.filter(~few), True), _side(members.filter(~few), False)
        level = lambda df, side: grid.reaching(df, F.lit(0), F.lit(0), F.col(f"{side}_y0"), F.col(f"{side}_y1"))
        reach = level(left, "l").select(*BLOCK, *grid.REACH).unionByName(level(right, "v").select(*BLOCK, *grid.REACH))
        sizes = materialize(grid.cell_sizes(reach, BLOCK))
        met = met.unionByName(
            grid.in_cells(level(left, "l").join(sizes, BLOCK)).alias("l")
            .join(grid.in_cells(level(right, "v").join(sizes, BLOCK)).alias("v"), grid.meeting("l", "v", BLOCK))
            .select(*[F.col(f"l.{c}").alias(c) for c in [*BLOCK, "nl", "nr"]], *[f"{x}_{c}" for x in "lv" for c in wanted]))
    shared = F.least("l_y1", "v_y1") - F.greatest("l_y0", "v_y0")
    overlap = F.when(shared > 0, shared / F.least("l_h", "v_h")).otherwise(0.0)
    claims = met.withColumn("overlap", overlap).filter(F.col("overlap") >= P.ROW_OVERLAP).select(
        *BLOCK, "nl", "l_pos", "v_pos", F.struct(
            "overlap", (-F.abs(F.col("l_centre") - F.col("v_centre"))).alias("near"), F.col("v_rank"), F.col("l_rank"), "l_pos", "v_pos").alias("claim"))
    # a block without a claim for every label fails anyway
    first = F.row_number().over(Window.partitionBy(*BLOCK, "l_pos").orderBy(F.desc("claim"))) == 1
    able = claims.repartition(*BLOCK).withColumn("_first", first).withColumn("_claimed", F.count_if("_first").over(block)).filter(
        F.col("_claimed") == F.col("nl")).select(*BLOCK, "l_pos", "v_pos", "claim")
    matched = dominant_claims(able)
    values = members.filter(~F.col("is_left")).select(*BLOCK, F.col("pos").alias("v_pos"), "nl", "nr", F.struct(*BOX, "h").alias("v"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    joined = (
        values.withColumns({"l_pos": F.lit(None).cast("bigint"), "l_rank": F.lit(None).cast("int")}).unionByName(matched.select(
            *BLOCK, "v_pos", none("bigint", "nl"), none("bigint", "nr"), none(values.schema["v"].dataType, "v"), "l_pos", F.col("claim.l_rank").cast("int").alias("l_rank")))
        .repartition(*BLOCK).groupBy(*BLOCK, "v_pos").agg(*[F.max(c).alias(c) for c in ("nl", "nr", "l_pos", "l_rank")], F.first("v", ignorenulls=True).alias("v"))
    )
    paired = F.col("l_pos").isNotNull()
    full = joined.withColumn("_n", F.count("l_pos").over(block)).filter(F.col("_n") == F.col("nl")).withColumn(
        "_w", F.first(F.when(~paired, F.col("v")), ignorenulls=True).over(block))
    host = (paired & (F.col("_w.y0") - F.col("v.y1")).between(F.lit(0), P.WRAP_GAP_RATIO * F.col("v.h"))
            & (F.least("_w.x1", "v.x1") > F.greatest("_w.x0", "v.x0")))
    settled = full.withColumn("_host", F.max(F.when(host, F.struct("v.y1", (-F.col("l_rank")).alias("o"), "l_pos"))).over(block)).filter(
        (F.col("nr") == F.col("nl")) | F.col("_host").isNotNull())
    return settled.select(*BLOCK, F.coalesce("l_pos", "_host.l_pos").alias("l_pos"), "v_pos", F.when(paired, 1).otherwise(2).alias("seq"))


def dominant_matching(claims: DataFrame) -> DataFrame:
    """Pairs (block, l_pos, v_pos) of the greedy one-to-one matching, best claim first."""
    return dominant_claims(claims).select(*BLOCK, "l_pos", "v_pos")


def dominant_claims(claims: DataFrame) -> DataFrame:
    """The claims that the greedy one-to-one matching takes, best first.

    `claims` has the block, both places and `claim`, which orders them strictly.
    A claim that is the best of its label and of its value is one that the greedy
    order takes whatever comes before it. So each round takes all of these at
    once and drops what they settle; a round leaves nothing but claims that were
    second best somewhere. A round deals the claims out by block, once.
    """
    sides = [Window.partitionBy(*BLOCK, side) for side in ("l_pos", "v_pos")]
    best = F.lit(True)
    for side in sides:
        best = best & (F.row_number().over(side.orderBy(F.desc("claim"))) == 1)
    rest, out = claims, None
    while out is None or not rest.isEmpty():
        flagged = rest.repartition(*BLOCK).withColumn("taken", best).withColumn(
            "settled", F.bool_or("taken").over(sides[0]) | F.bool_or("taken").over(sides[1]))
        flagged = materialize(flagged.filter("taken or not settled"))
        taken = flagged.filter("taken").drop("taken", "settled")
        out = taken if out is None else out.unionByName(taken)
        rest = flagged.filter("not taken").drop("taken", "settled")
    return out


def pairs_by_rank(members: DataFrame) -> DataFrame:
    """Nth label to nth value where the columns are shifted by one constant.

    In the order of their ranks, labels and values of an even block alternate.
    """
    even = members.filter((F.col("nl") == F.col("nr")) & (F.col("nl") >= 2) & F.col("is_left").isNotNull()).select(
        *BLOCK, "pos", "is_left", "rank", "centre")
    block = Window.partitionBy(*BLOCK)
    order = block.orderBy("rank", F.desc("is_left"))
    zipped = even.withColumns({
        "v_pos": F.lead("pos").over(order), "step": F.col("centre") - F.lag("centre", 2).over(order),
        "offset": F.lead("centre").over(order) - F.col("centre")}).filter("is_left")
    shape = {"pitch": F.median("step"), "middle": F.median("offset"), "lo": F.min("offset"), "hi": F.max("offset")}
    uniform = zipped.withColumns({name: value.over(block) for name, value in shape.items()}).filter(
        (F.col("pitch") > 0)
        & (F.greatest(F.abs(F.col("hi") - F.col("middle")), F.abs(F.col("lo") - F.col("middle")))
           <= P.RANK_TOLERANCE * F.col("pitch")))
    return uniform.select(*BLOCK, F.col("pos").alias("l_pos"), "v_pos", F.lit(1).alias("seq"))


def table_pairs(members: DataFrame) -> DataFrame:
    """Pairs of the strategy each block earns, with its name in `strategy`.

    A complete row cover wins. Otherwise overlap geometry (only where rows say
    nothing at all), then rank, then the partial row cover. Each way is tried
    only on the blocks that the ways before it leave open.
    """
    by_row = materialize(pairs_by_row(members))
    spoken = by_row.groupBy(*BLOCK).agg(F.count_if(F.col("seq") == 1).alias("labels"))  # each label has one first value
    place = [*BLOCK, "pos", "is_left", "rank", *BOX, "centre", "h", "nl", "nr"]
    silent = materialize(members.select(*place).join(spoken, BLOCK, "left_anti"))
    by_geometry = materialize(pairs_by_geometry(silent))
    unsettled = (
        members.select(*place).filter(F.col("nl") == F.col("nr")).join(spoken, BLOCK, "left")
        .filter(F.col("labels").isNull() | (F.col("labels") < F.col("nl")))
        .join(by_geometry.select(*BLOCK).distinct(), BLOCK, "left_anti"))
    by_rank = materialize(pairs_by_rank(unsettled))
    rows = by_row.join(by_rank.select(*BLOCK).distinct(), BLOCK, "left_anti")
    return (
        rows.withColumn("strategy", F.lit("row"))
        .unionByName(by_geometry.withColumn("strategy", F.lit("geometry")))
        .unionByName(by_rank.withColumn("strategy", F.lit("rank")))
    )


def merged_lines(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One 'label value' line per pair, boxed around its parts.

    Lines and pairs of a block meet by their key alone, in one shuffle; a pair
    gets its value's part from a window, and its label when it is grouped.
    """
    whole = F.struct("text", "confidence", *BOX, "rank", "image_index", "row_index", "column_index")
    lines = members.select(*BLOCK, "pos", "is_left", whole.alias("line"), F.lit(None).cast("bigint").alias("l_pos"), F.lit(None).cast("bigint").alias("seq"))
    both = lines.unionByName(
        pairs.select(*BLOCK, F.col("v_pos").alias("pos"), F.lit(False).alias("is_left"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"),
                     F.col("l_pos").cast("bigint").alias("l_pos"), F.col("seq").cast("bigint").alias("seq"))).repartition(*BLOCK)
    value = F.first("line", ignorenulls=True).over(Window.partitionBy(*BLOCK, "pos"))
    placed = both.withColumn("_line", value).filter("is_left or seq is not null")
    label, part = F.when(F.col("is_left"), F.col("line")), F.when(~F.col("is_left"), F.col("_line"))
    whole = (
        placed.withColumns({"l_pos": F.coalesce("l_pos", "pos"), "_l": label, "_v": part})
        .groupBy(*BLOCK, "l_pos").agg(
            F.first("_l", ignorenulls=True).alias("l"),
            F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", F.col("_v.text").alias("v_text"))))).alias("parts"),
            *[F.min(f"_v.{c}").alias(c) for c in ("x0", "y0")], *[F.max(f"_v.{c}").alias(c) for c in ("x1", "y1")],
            F.sum("_v.confidence").alias("v_sum"), F.count("_v.confidence").alias("v_n"))
        .filter(F.size("parts") > 0)
    )
    total = F.coalesce("l.confidence", F.lit(0.0)) + F.coalesce("v_sum", F.lit(0.0))
    n = F.col("v_n") + F.when(F.col("l.confidence").isNotNull(), 1).otherwise(0)
    return whole.select(
        "scan_id", "l.image_index",
        (F.lit(MERGED_BASE) + F.col("run")).alias("ord"), F.col("l.rank").cast("bigint").alias("rank"),
        F.concat_ws(" ", F.array(F.col("l.text")), F.transform("parts", lambda p: p["v_text"])).alias("text"),
        *[F.least(f"l.{c}", c).alias(c) for c in ("x0", "y0")], *[F.greatest(f"l.{c}", c).alias(c) for c in ("x1", "y1")],
        T.round_half_even(total / F.when(n > 0, n), 3).alias("confidence"),
        "l.row_index", "l.column_index")


def merge_columns(lines: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Add the merged lines and re-read the scans that gained any, by position.

    Scans without a table keep their order; the others are sorted by top edge,
    then left edge, across all their images. Where no scan is oversized, windows
    by scan do both; `lines` should be a written table.
    """
    members = table_blocks(lines, options)
    if members.isEmpty():
        return lines.withColumn("merged", F.lit(False))
    merged = merged_lines(members, table_pairs(members))
    cols = ["scan_id", "image_index", "ord", "rank", "text", *BOX, "confidence", "row_index", "column_index"]
    if oversized_scans(lines).isEmpty():
        scan = Window.partitionBy("scan_id")
        both = lines.withColumns({"ord": F.col("pos"), "rank": F.lit(0).cast("bigint")}).select(*cols).unionByName(merged.select(*cols))
        read = both.withColumn("merged", F.col("ord") >= MERGED_BASE).withColumns({
            "_touched": F.max("merged").over(scan), "_pos": F.row_number().over(scan.orderBy("y0", "x0", "ord", "rank")) - 1})
        return materialize(read.select(
            *[c for c in cols if c not in ("ord", "rank")],
            F.when(F.col("_touched"), F.col("_pos").cast("bigint")).otherwise(F.col("ord")).alias("pos"), "merged"))
    merged = materialize(merged)
    touched = merged.select("scan_id").distinct()
    calm = lines.join(touched, "scan_id", "left_anti")
    stirred = (
        lines.join(touched, "scan_id", "left_semi").withColumn("ord", F.col("pos"))
        .withColumn("rank", F.lit(0).cast("bigint"))
        .select(*cols).unionByName(merged.select(*cols))
    )
    renewed = positions(materialize(stirred), ["y0", "x0", "ord"], ties=["rank"])
    return materialize(
        calm.select(*[c for c in cols if c not in ("ord", "rank")], "pos", F.lit(False).alias("merged"))
        .unionByName(renewed.select(*[c for c in cols if c not in ("ord", "rank")], "pos",
                                    (F.col("ord") >= MERGED_BASE).alias("merged")))
    )
