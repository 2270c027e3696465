"""Lines in reading order: positions, image runs, context and label neighbours.

A scan is cut into chunks of CHUNK positions, and (scan_id, chunk) is the
partition key of every window, so no task ever holds a whole oversized scan.
Rows near a chunk edge are copied into the neighbouring chunk as a halo, which
makes the bounded frames exact. Almost every scan is one chunk; the parts that
need sums over earlier chunks read only the scans that have more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.operators import grid
from labelscope.session import materialize

CHUNK = 4096
BACK, AHEAD = 2, 7
FOLLOWING = 5

# fixed values: label-to-value distances, in multiples of the taller text height
ROW_ALIGN = 0.6
RIGHT_GAP = 4.0
BELOW_GAP = 2.0
EDGE = 0.25

BOX = ["x0", "y0", "x1", "y1"]


def chunk_of(pos: Column) -> Column:
    return F.floor(pos / CHUNK)


def oversized_scans(lines: DataFrame) -> DataFrame:
    """Scans with more than one chunk: a pruned, pushed-down and usually empty read."""
    return lines.filter(F.col("pos") >= CHUNK).select("scan_id").distinct()


def positions(lines: DataFrame, order: list[str], out: str = "pos", ties: list[str] | None = None) -> DataFrame:
    """Dense 0-based position of each row within its scan.

    `order` names the sort columns, of which the last is a whole number; with
    `ties` behind them, they tell all rows of a scan apart. An oversized scan is ranked in small buckets instead: rows
    with equal leading columns form a level (at most one per pixel row of an
    image), and a level is cut by the last two columns. Counts of levels and of
    buckets within a level then give every bucket its offset. Hardly any table
    has such a scan, so a count looks for one first; `lines` is read twice and
    should be a written table.
    """
    level, inner = order[:-2], order[-2:]
    sizes = lines.groupBy("scan_id").count().filter(F.col("count") > CHUNK)
    if sizes.isEmpty():
        whole = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order, *(ties or [])))
        return lines.withColumn(out, whole.cast("long") - 1)
    big = materialize(sizes.select("scan_id", F.lit(True).alias("_big")))

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("_level", F.when(F.col("_big"), F.struct(*[
            F.col(c).cast("double").alias(c) for c in level]))).withColumn(
            "_bucket", F.when(F.col("_big"), F.struct(
                F.col(inner[0]).cast("double").alias("a"),
                F.floor(F.col(inner[1]) / CHUNK).cast("double").alias("b"))))

    keys = ["scan_id", "_level", "_bucket"]
    tagged = bucketed(lines.join(big, "scan_id", "left"))
    ranked = tagged.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *(ties or []))).cast("long"))
    counts = bucketed(lines.join(big, "scan_id")).groupBy(*keys).agg(F.count("*").alias("_n"))

    def before(df: DataFrame, part: list[str], by: str, name: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)))

    levels = before(counts.groupBy("scan_id", "_level").agg(F.sum("_n").alias("_n")),
                    ["scan_id"], "_level", "_above").drop("_n")
    offsets = before(counts, ["scan_id", "_level"], "_bucket", "_within").join(
        levels, ["scan_id", "_level"]).select(*keys, (F.col("_above") + F.col("_within")).alias("_skip"))
    return (
        ranked.join(offsets, keys, "left")
        .withColumn(out, F.col("_rn") - 1 + F.coalesce("_skip", F.lit(0)))
        .drop("_big", "_level", "_bucket", "_rn", "_skip")
    )


def with_halo(lines: DataFrame) -> DataFrame:
    """Copy the rows near each chunk edge into the neighbouring chunk."""
    home, r = chunk_of(F.col("pos")), F.col("pos") % CHUNK
    targets = F.array_compact(
        F.array(
            home,
            F.when((r < AHEAD) & (home > 0), home - 1),
            F.when(r >= CHUNK - BACK, home + 1),
        )
    )
    return (
        lines.withColumn("chunk", F.explode(targets))
        .withColumn("own", F.col("chunk") == chunk_of(F.col("pos")))
    )


def _order():
    return Window.partitionBy("scan_id", "chunk").orderBy("pos")


def _changes(lines: DataFrame) -> DataFrame:
    """Mark the first line of every image run and count runs within the chunk."""
    prev = F.lag("image_index").over(_order())
    marked = lines.withColumn(
        "_new", F.when(prev.isNull() | (prev != F.col("image_index")), 1).otherwise(0))
    counted = F.sum(F.when(F.col("own"), F.col("_new")).otherwise(0)).over(
        _order().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_local_run", counted)


def image_runs(lines: DataFrame) -> DataFrame:
    """Number the contiguous runs of lines that share an image (`run`).

    Chunks are cut and runs counted through them only if a scan is oversized;
    `lines` should be a written table, which tells at a glance. Otherwise scans
    are dealt out whole, and steps by scan, run or chunk go on where they lie.
    """
    if oversized_scans(lines).isEmpty():
        whole = lines.withColumns({"chunk": F.lit(0).cast("bigint"), "own": F.lit(True)})
        return _changes(whole).withColumn("run", F.col("_local_run")).drop("_new", "_local_run")
    marked = _changes(with_halo(lines))
    wide = lines.select("scan_id", "pos", "image_index").join(
        oversized_scans(lines), "scan_id", "left_semi")
    totals = _changes(with_halo(wide)).filter("own").groupBy("scan_id", "chunk").agg(
        F.sum("_new").alias("_n"))
    before = Window.partitionBy("scan_id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        "scan_id", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    return (
        marked.join(offsets, ["scan_id", "chunk"], "left")
        .withColumn("run", F.col("_local_run") + F.coalesce("_skip", F.lit(0)))
        .drop("_new", "_local_run", "_skip")
    )


def in_sequence(lines: DataFrame) -> DataFrame:
    """Add image run, context windows and the lines that follow in the same run.

    ctx1 and ctx2 join the texts within one and two lines; `following` holds
    the next FOLLOWING lines. None of them crosses into another image.
    """
    w = _order()
    img = F.col("image_index")

    def text_at(offset: int) -> Column:
        step = 1 if offset > 0 else -1
        text = F.lead("text", offset).over(w)
        for k in range(step, offset + step, step):
            text = F.when(F.lead("image_index", k).over(w) == img, text)
        return text

    bar = " | "
    own_text = F.col("text")
    ctx = image_runs(lines).withColumns({
        "ctx1": F.concat_ws(bar, text_at(-1), own_text, text_at(1)),
        "ctx2": F.concat_ws(bar, text_at(-2), text_at(-1), own_text, text_at(1), text_at(2)),
    })
    item = F.struct("pos", "image_index", "text", "confidence", *BOX, "ctx2")
    seq = ctx.withColumn("following", F.collect_list(item).over(w.rowsBetween(1, FOLLOWING)))
    cut = F.array_position(
        F.transform("following", lambda x: x["image_index"] != img), F.lit(True))
    return (
        seq.filter("own")
        .withColumn("following", F.when(cut > 0, F.slice("following", F.lit(1), (cut - 1).cast("int")))
                    .otherwise(F.col("following")))
        .drop("own")
    )


def value_geometry(label: str, cand: str) -> Column:
    """struct(gap, direction) when a line may hold a label's value, else NULL."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("double")

    lh = F.greatest(F.lit(1.0), c(label, "y1") - c(label, "y0"))
    ch = F.greatest(F.lit(1.0), c(cand, "y1") - c(cand, "y0"))
    h = F.greatest(lh, ch)
    edge = EDGE * h
    shift = F.abs((c(cand, "y0") + c(cand, "y1")) / 2 - (c(label, "y0") + c(label, "y1")) / 2)
    right_gap = (c(cand, "x0") - c(label, "x1")) / h
    right = (c(cand, "x0") >= c(label, "x1") - edge) & (shift <= ROW_ALIGN * h) & (right_gap <= RIGHT_GAP)
    below_gap = (c(cand, "y0") - c(label, "y1")) / h
    overlap = F.least(c(cand, "x1"), c(label, "x1")) > F.greatest(c(cand, "x0"), c(label, "x0"))
    aligned = F.abs(c(cand, "x0") - c(label, "x0")) <= h
    below = (c(cand, "y0") >= c(label, "y1") - edge) & (overlap | aligned) & (below_gap <= BELOW_GAP)
    return (
        F.when(right, F.struct(F.bround(right_gap, 3).alias("gap"), F.lit(0).alias("direction")))
        .when(below, F.struct(F.bround(below_gap, 3).alias("gap"), F.lit(1).alias("direction")))
    )


BAND = 64  # pixels


def bands(low: Column, high: Column) -> Column:
    """Every horizontal band that a vertical stretch touches."""
    return F.sequence(F.floor(low / BAND), F.floor(high / BAND))


def value_candidates(labels: DataFrame, lines: DataFrame, count: int = FOLLOWING) -> DataFrame:
    """Add `cands`: up to `count` lines that may hold each label line's value.

    Where the boxes of the run differ, geometry alone decides: to the right in
    the row, or below and aligned, nearest first. Label and line meet in the
    grid cells that both reach (a reach grows with the text height), so neither a
    crowded image nor one long row pairs all its lines; the nearest are kept
    before and after the shuffle. Where all boxes are equal the following lines
    are taken, and the run never reaches the join.
    """
    run = ["scan_id", "run"]
    h = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    near = grid.reaching(
        lines.select(*run, "pos", "image_index", "text", "confidence", *BOX, "ctx2"),
        left - RIGHT_GAP * h, right + h, F.col("y0") - BELOW_GAP * h, F.col("y1") + ROW_ALIGN * h)
    keys = grid.reaching(labels.select(*run, "pos", *BOX), left - h, right + RIGHT_GAP * h, F.col("y0") - ROW_ALIGN * h, F.col("y1") + BELOW_GAP * h)
    # a label's reach counts too: either may hold a box too large for cells
    sizes = grid.cell_sizes(
        near.select(*run, *grid.REACH, *BOX).unionByName(keys.select(*run, *grid.REACH, *BOX)), run,
        (F.min(F.struct(*BOX)) != F.max(F.struct(*BOX))).alias("differs")).filter("differs").drop("differs")
    spread = materialize(sizes.join(keys.select(*run).distinct(), run, "left_semi"))
    item = F.struct(
        F.col("_g.gap").alias("gap"), F.col("_g.direction").alias("direction"),
        *[F.col(f"c.{n}").alias(n) for n in ["pos", "image_index", "text", "confidence", *BOX, "ctx2"]])
    pairs = (
        grid.in_cells(keys.join(spread, run)).alias("l")
        .join(grid.in_cells(near.join(spread, run)).alias("c"), grid.meeting("l", "c", run) & (F.col("l.pos") != F.col("c.pos")))
        .withColumn("_g", value_geometry("l", "c")).filter("_g is not null")
        .select(F.col("l.scan_id").alias("scan_id"), F.col("l.run").alias("run"),
                F.col("l.pos").alias("pos"), item.alias("cand"))
    )
    nearest = Window.partitionBy(*run, "pos").orderBy("cand.gap", "cand.direction", "cand.pos")
    best = (
        pairs.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= count)
        .groupBy(*run, "pos").agg(F.array_sort(F.collect_list("cand")).alias("near"))
    )
    plain = F.transform(
        F.coalesce("near", F.array()), lambda x: F.struct(*[
            x[n].alias(n) for n in ["pos", "image_index", "text", "confidence", *BOX, "ctx2"]]))
    return (
        labels.join(best, [*run, "pos"], "left").join(spread.select(*run, F.lit(True).alias("differs")), run, "left")
        .withColumn("cands", F.when(F.col("differs"), plain).otherwise(F.slice("following", 1, count)))
        .drop("differs", "near")
    )

