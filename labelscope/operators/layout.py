"""Detections to lines: fuse repeated reads, cluster rows, split columns, orient.

The order-dependent steps work on what can depend on each other: fusion folds
groups of reads that a grid join links, rows are swept in order of their words'
centres with the open rows as state, columns are cut within a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.functions import patterns as P
from labelscope.functions import text as T
from labelscope.operators import grid
from labelscope.operators.sequence import BOX, bands, positions
from labelscope.session import materialize

IMAGE = ["scan_id", "image_index"]
PAGE = [*IMAGE, "frame"]
GROUP = "_group"  # of linked reads, NULL for the other words
FEW_WORDS = 256  # words of an image whose reads meet in one cell
WORD = ["y0", "x0", "word_ord", "x1", "y1", "pass_index", "text", "confidence"]
WORD_TYPE = ("struct<y0:double,x0:double,word_ord:bigint,x1:double,y1:double,pass_index:int,"
             "text:string,confidence:double>")


def _word() -> Column:
    return F.struct(*WORD).cast(WORD_TYPE)


def both_frames(words: DataFrame) -> DataFrame:
    """Each image as it is and turned by 180 degrees within its own extent."""
    image = Window.partitionBy(*IMAGE)
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    known = words.filter(F.col("scan_id").isNotNull() & F.col("image_index").isNotNull())
    wide = known.withColumns({"w": F.max("x1").over(image), "h": F.max("y1").over(image)}).withColumn("frame", both)
    turned = F.col("frame") == 1
    c = F.col
    return wide.select(
        *PAGE, "word_ord", "pass_index", "text", "confidence",
        F.when(turned, c("w") - c("x1")).otherwise(c("x0")).alias("x0"),
        F.when(turned, c("h") - c("y1")).otherwise(c("y0")).alias("y0"),
        F.when(turned, c("w") - c("x0")).otherwise(c("x1")).alias("x1"),
        F.when(turned, c("h") - c("y0")).otherwise(c("y1")).alias("y1"),
        *[c(n) for n in words.columns if n == GROUP])


def upright(words: DataFrame) -> DataFrame:
    return words.withColumn("frame", F.lit(0))


def _fuse(kept: Column, word: Column) -> Column:
    """Add a word, or let it replace the first kept word that it repeats."""

    def repeats(k: Column) -> Column:
        overlap = T.iou(word, k)
        same = T.token_key(word["text"]) == T.token_key(k["text"])
        return (word["pass_index"] != k["pass_index"]) & (
            (same & (overlap >= P.SAME_TOKEN_IOU)) | (overlap >= P.STRONG_IOU)
            | (T.containment(word, k) >= P.CONTAINMENT))

    def better(k: Column) -> Column:
        new, old = F.length(T.token_key(word["text"])), F.length(T.token_key(k["text"]))
        return (new > old) | ((new == old) & (word["confidence"] > k["confidence"]))

    at = F.array_position(F.transform(kept, repeats), F.lit(True))
    return T.let(at, lambda i: F.when(i == 0, F.array_append(kept, word)).otherwise(
        F.transform(kept, lambda k, n: F.when((n == i - 1) & better(k), word).otherwise(k))))


def repeated_reads(words: DataFrame) -> DataFrame:
    """scan_id, image_index, word_ord, group of the words that another pass may have read as well.

    Two reads repeat each other by their boxes and texts alone, whatever was
    kept before, so only words that such pairs link can touch each other's fate.
    The words of later passes meet those of earlier ones, in an image of up to
    FEW_WORDS words by image, else in grid cells, and boxes must overlap before
    more is compared; turning an image changes no pair, so one frame is enough.
    """
    read = words.filter("frame = 0").select(*IMAGE, "word_ord", "pass_index", "text", *BOX)
    passes = read.agg(F.min("pass_index").alias("_first"), F.max("pass_index").alias("_last"))  # one row
    flat = grid.reaching(read, F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1"))
    crowded = materialize(grid.cell_sizes(flat, IMAGE, few=FEW_WORDS).filter("not _few"), free=True)
    sized = flat.join(F.broadcast(passes)).join(crowded, IMAGE, "left").withColumn("_few", F.coalesce("_few", F.lit(True)))
    cells = grid.in_cells(sized.withColumn("key", T.token_key(F.col("text"))).drop("text"))
    a, b = (F.struct(*[F.col(f"{side}.{c}").alias(c) for c in BOX]) for side in "ab")
    overlap = T.iou(a, b)
    same = (F.col("a.key") == F.col("b.key")) & (overlap >= P.SAME_TOKEN_IOU)
    touch = (F.least("a.x1", "b.x1") > F.greatest("a.x0", "b.x0")) & (F.least("a.y1", "b.y1") > F.greatest("a.y0", "b.y0"))
    near = cells.filter("pass_index > _first").drop("_first", "_last").alias("a").join(
        cells.filter("pass_index < _last").drop("_first", "_last").alias("b"),
        grid.meeting("a", "b", IMAGE) & (F.col("a.pass_index") > F.col("b.pass_index")) & touch)
    # shares are compared behind the join: with them in it, its code is too long for the JVM to compile
    pair = F.struct(F.col("a.word_ord").alias("u"), F.col("b.word_ord").alias("v"))
    linked = same | (overlap >= P.STRONG_IOU) | (T.containment(a, b) >= P.CONTAINMENT)
    edges = near.select(*[F.col(f"a.{c}").alias(c) for c in IMAGE], F.explode(F.when(linked, F.array(pair))).alias("e")).select(*IMAGE, "e.*")
    return grid.components(edges, IMAGE).select(*IMAGE, F.col("node").alias("word_ord"), F.col("root").alias("group"))


def linked_reads(words: DataFrame) -> DataFrame:
    """Words with the GROUP of reads they are linked to, dealt out by image: what follows by image, page or group shares that shuffle."""
    groups = repeated_reads(words).withColumnRenamed("group", GROUP).withColumn("_word", F.lit(False))
    every = words.withColumn("_word", F.lit(True)).unionByName(groups, allowMissingColumns=True).repartition(*IMAGE)
    spot = Window.partitionBy(*IMAGE, "word_ord")
    return every.withColumn(GROUP, F.max(GROUP).over(spot)).filter("_word").drop("_word")


def folded(words: DataFrame) -> DataFrame:
    """Words with a GROUP: those of a group folded, of each page by itself; the others as they are."""
    rest = [c for c in words.columns if c not in (*PAGE, GROUP)]
    linked = F.col(GROUP).isNotNull()
    spots = words.groupBy(*PAGE, linked.alias("linked"), F.coalesce(GROUP, "word_ord").alias("spot")).agg(
        F.collect_list(F.struct(*rest)).alias("words"))
    reads = F.array_sort(F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in WORD]).cast(WORD_TYPE)))
    kept = F.transform(F.aggregate(reads, F.expr(f"cast(array() as array<{WORD_TYPE}>)"), _fuse), lambda w: w["word_ord"])
    left = F.when(F.col("linked"), T.let(kept, lambda k: F.filter("words", lambda w: F.array_contains(k, w["word_ord"])))).otherwise(F.col("words"))
    return spots.select(*PAGE, F.explode(left).alias("w")).select(*[c if c in PAGE else f"w.{c}" for c in words.columns if c != GROUP])


def fuse_passes(words: DataFrame) -> DataFrame:
    """Words with repeated reads of other passes dropped.

    `word_ord` tells the words of an image apart. The fold runs over groups of
    linked words, a few reads of one spot; all other words only pass by.
    """
    return folded(linked_reads(words))


class OpenRows:
    """Rows of one image while its words come in order of their centres.

    A row is the running mean of its centres, the upper median of its heights
    (two heaps) and its words. Centres only grow, so a row too far above the
    current word is closed, and closed rows leave in order of their centres as
    soon as no open row can end above them.
    """

    def __init__(self):
        self.open, self._closed, self._made, self._left = [], [], 0, 0

    def add(self, word: int, centre: float, height: float) -> Iterator[tuple[int, float, list[int]]]:
        """Put a word into the first row whose centre is near, or open a row; give (row_index, middle, words) of rows that leave."""
        tolerance, still, place = P.ROW_CENTRE_TOLERANCE, [], None
        for row in self.open:
            if centre - row["centre"] > tolerance * row["high"][0]:
                heapq.heappush(self._closed, (row["centre"], row["made"], row))
                continue
            still.append(row)
            if place is None and abs(centre - row["centre"]) <= tolerance * min(height, row["high"][0]):
                place = row
        self.open = still
        if place is None:
            still.append({"centre": centre, "made": self._made, "low": [], "high": [height], "words": [word]})
            self._made += 1
        else:
            place["words"].append(word)
            n = len(place["words"])
            place["centre"] += (centre - place["centre"]) / n
            heapq.heappush(place["high"], -heapq.heappushpop(place["low"], -height))
            if len(place["low"]) < n // 2:
                heapq.heappush(place["low"], -heapq.heappop(place["high"]))
        yield from self._leave(min((r["centre"], r["made"]) for r in still))

    def _leave(self, before: tuple[float, int]) -> Iterator[tuple[int, float, list[int]]]:
        while self._closed and self._closed[0][:2] < before:
            row = heapq.heappop(self._closed)[2]
            yield self._left, row["high"][0], row["words"]
            self._left += 1

    def end(self) -> Iterator[tuple[int, float, list[int]]]:
        for row in self.open:
            heapq.heappush(self._closed, (row["centre"], row["made"], row))
        self.open = []
        yield from self._leave((float("inf"), 0))

    def renumber(self) -> list[int]:
        """Words that have not left, which go by their places in this list from now on."""
        rows = [*self.open, *(row for _, _, row in self._closed)]
        words = sorted(w for row in rows for w in row["words"])
        places = {w: k for k, w in enumerate(words)}
        for row in rows:
            row["words"] = [places[w] for w in row["words"]]
        return words


def _sweep(batches):
    """Rows of words that come image by image in order of (centre, x0, word_ord); a batch carries its unfinished rows into the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows_of(table, found):
        sizes = [len(words) for _, _, words in found]
        flat = np.array([w for _, _, words in found for w in words], np.int64)
        x0 = table.column("x0").to_numpy()[flat]
        order = np.lexsort((np.arange(len(flat)), x0, np.repeat(np.arange(len(found)), sizes)))
        words = table.take(pa.array(flat[order])).combine_chunks()
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        packed = pa.StructArray.from_arrays([pa.concat_arrays(words.column(c).chunks) for c in WORD], names=WORD)
        firsts = table.take(pa.array([words[0] for _, _, words in found]))
        return pa.RecordBatch.from_arrays(
            [*(pa.concat_arrays(firsts.column(c).chunks) for c in PAGE), pa.array([r for r, _, _ in found], pa.int32()),
             pa.array([m for _, m, _ in found], pa.float64()), pa.ListArray.from_arrays(offsets, packed)],
            names=[*PAGE, "row_index", "middle", "words"])

    carried, rows = None, OpenRows()
    for batch in batches:
        table = pa.Table.from_batches([batch])
        first = carried.num_rows if carried is not None else 0
        if first:
            table = pa.concat_tables([carried, table]).combine_chunks()
        if table.num_rows == first:
            continue
        fresh = np.zeros(table.num_rows, bool)  # carried words are of the image that comes next, or was last
        for c in PAGE:
            column = table.column(c)
            fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
        found = []
        for k, new, centre, height in zip(
                range(first, table.num_rows), fresh[first:].tolist(), table.column("centre").slice(first).to_pylist(), table.column("height").slice(first).to_pylist()):
            if new:
                found += rows.end()
                rows = OpenRows()
            found += rows.add(k, centre, height)
        if found:
            yield rows_of(table, found)
        carried = table.take(pa.array(rows.renumber(), pa.int64()))
    if carried is not None and (found := list(rows.end())):
        yield rows_of(carried, found)


def cluster_rows(words: DataFrame) -> DataFrame:
    """Physical rows of every image, words from left to right: row_index counts from the top.

    An image's words stream through one task in order; the memory is that of the
    rows still open, however many words the image has. Words that are dealt out
    by image already stay where they are.
    """
    centre, height = (F.col("y0") + F.col("y1")) / 2.0, F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")).cast("double"))
    typed = words.select(*PAGE, _word().alias("w"), centre.alias("centre"), height.alias("height")).select(*PAGE, "w.*", "centre", "height")
    ordered = typed.repartition(*IMAGE).sortWithinPartitions(*PAGE, "centre", "x0", "word_ord")
    page = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed.schema.fields[:len(PAGE)])
    return ordered.mapInArrow(_sweep, f"{page}, row_index int, middle double, words array<{WORD_TYPE}>")


RUNS_TYPE = f"struct<right:double,runs:array<array<{WORD_TYPE}>>>"


def _extend(acc: Column, word: Column, middle: Column) -> Column:
    """Add the next word of a row: to a new run past a column gap, else to the last.

    A word that repeats the last one kept stays only if it was read more surely.
    """
    runs = acc["runs"]
    last = F.get(runs, F.size(runs) - 1)
    tail = F.get(last, F.size(last) - 1)
    gap = acc["right"].isNull() | (word["x0"] - acc["right"] > P.COLUMN_GAP_RATIO * middle)
    key = T.token_key(word["text"])
    repeat = (key != "") & (key == T.token_key(tail["text"]))
    all_but_last = F.slice(runs, F.lit(1), F.size(runs) - 1)
    surer = F.when(
        word["confidence"] > tail["confidence"],
        F.array_append(F.slice(last, F.lit(1), F.size(last) - 1), word)).otherwise(last)
    return F.struct(
        word["x1"].alias("right"),
        F.when(gap, F.array_append(runs, F.array(word)))
        .when(repeat, F.array_append(all_but_last, surer))
        .otherwise(F.array_append(all_but_last, F.array_append(last, word))).alias("runs"))


def assemble_lines(rows: DataFrame) -> DataFrame:
    """Rows cut at column gaps, repeated neighbours collapsed, one line per run."""
    start = F.expr(f"cast(named_struct('right', null, 'runs', array()) as {RUNS_TYPE})")
    runs = F.aggregate("words", start, lambda acc, w: _extend(acc, w, F.col("middle")))["runs"]
    lined = rows.select(*PAGE, "row_index", F.posexplode(runs).alias("column_index", "words"))

    def edge(name: str, pick) -> Column:
        return pick(F.transform("words", lambda w: w[name])).alias(name)

    total = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + w["confidence"])
    return lined.select(
        *PAGE, "row_index", "column_index",
        F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"),
        edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max),
        T.round_half_even(total / F.size("words"), 3).alias("confidence"), "words")


def detections_to_lines(words: DataFrame) -> DataFrame:
    """Words (with `frame`, 0 among them) to lines of every image and frame."""
    return assemble_lines(cluster_rows(fuse_passes(words)))


def lines_both_ways(words: DataFrame) -> DataFrame:
    """Words (without `frame`) to lines of every image in both frames; the words are dealt out once, before they are turned."""
    linked = linked_reads(upright(words)).drop("frame")
    return assemble_lines(cluster_rows(folded(both_frames(linked))))


def orientation_scores(lines: DataFrame) -> DataFrame:
    """How far each frame reads as labels followed by values, per image.

    A label counts 1, and the first plain line in reading order that stands to
    its right (1) or just below (0.5) adds to it. Pairs meet by y band.
    """
    tagged = lines.withColumn("is_label", T.found(F.col("text"), P.ORIENTATION_LABEL))
    order = ["y0", "x0", "row_index", "column_index"]
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    labels = tagged.filter("is_label").select(*PAGE, *order, "x1", "y1").withColumn(
        "_band", F.explode(bands(F.col("y0"), F.col("y1") + 2 * height)))
    others = tagged.filter(~F.col("is_label")).select(*PAGE, *order, "x1", "y1").withColumn(
        "_band", F.explode(bands(F.col("y0"), F.col("y1"))))

    def l(name: str) -> Column:
        return F.col(f"l.{name}")

    def o(name: str) -> Column:
        return F.col(f"o.{name}")

    in_row = (F.least(o("y1"), l("y1")) > F.greatest(o("y0"), l("y0"))) & (o("x0") >= l("x1"))
    drop = o("y0") - l("y1")
    below = drop.between(F.lit(0.0), 2 * F.greatest(F.lit(1.0), l("y1") - l("y0")))
    on = F.col("l._band") == F.col("o._band")
    for k in PAGE:
        on = on & (l(k) == o(k))
    bonus = F.when(in_row, 1.0).when(below, 0.5)
    firsts = (
        labels.alias("l").join(others.alias("o"), on)
        .withColumn("bonus", bonus).filter("bonus is not null")
        .groupBy(*[l(k).alias(k) for k in PAGE], *[l(k).alias(f"l_{k}") for k in order])
        .agg(F.min_by("bonus", F.struct(*[o(k) for k in order])).alias("bonus"))
    )
    base = tagged.groupBy(*PAGE).agg(F.count_if("is_label").cast("double").alias("labels"))
    extra = firsts.groupBy(*PAGE).agg(F.sum("bonus").alias("bonus"))
    return base.join(extra, PAGE, "left").select(
        *PAGE, (F.col("labels") + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def choose_orientation(scores: DataFrame) -> DataFrame:
    """The frame of each image: turned only when it scores strictly higher."""
    return scores.groupBy("scan_id", "image_index").agg(
        F.coalesce(F.max(F.when(F.col("frame") == 0, F.col("score"))), F.lit(0.0)).alias("upright_score"),
        F.coalesce(F.max(F.when(F.col("frame") == 1, F.col("score"))), F.lit(0.0)).alias("flipped_score"),
    ).withColumn("frame", F.when(F.col("flipped_score") > F.col("upright_score"), 1).otherwise(0))


def reading_order(lines: DataFrame) -> DataFrame:
    """Positions in a scan: images in turn, each from top to bottom, left to right."""
    return positions(lines, ["image_index", "y0", "x0", "row_index"], ties=["column_index"])


def read_labels(words: DataFrame) -> DataFrame:
    """Detections of many images to oriented lines in reading order."""
    lines = materialize(lines_both_ways(words), free=True)
    chosen = materialize(choose_orientation(orientation_scores(lines)).select(*PAGE), free=True)
    return reading_order(lines.join(chosen, PAGE, "left_semi").drop("frame"))
