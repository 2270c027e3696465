"""Joins of nearby boxes: cells in both directions, and components of what they link.

Each group (an image run, a page, a table block) gets cells of its own size, the
geometric mean of its boxes' reach, which one absurd box hardly moves. Two boxes
meet in every cell that both reach; a pair counts in one of them only, the cell
of their larger first column and larger first row. A group of few boxes is one
cell. A box that reaches more than
MOST_CELLS cells lies in a single cell for the whole group instead, where the
group's other boxes come to meet it. So crowded pages cost pairs of close boxes,
not all pairs, and no box is copied more than MOST_CELLS times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelscope.session import materialize

MOST_CELLS = 64
FEW = 24  # boxes of a group that meet in one cell without more ado
REACH = ["_gx0", "_gx1", "_gy0", "_gy1"]
CELL = ["_level", "_cx", "_cy"]


def reaching(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """Add how far each box reaches."""
    return df.withColumns({n: c.cast("double") for n, c in zip(REACH, (x0, x1, y0, y1))})


def cell_sizes(boxes: DataFrame, keys: list[str], *more: Column, few: int = FEW) -> DataFrame:
    """Cell size per group of reaching boxes, whether they are few, and whether some box may be too large for cells; `more` is aggregated along."""
    wide = F.greatest(F.lit(1.0), F.col("_gx1") - F.col("_gx0"))
    high = F.greatest(F.lit(1.0), F.col("_gy1") - F.col("_gy0"))
    sizes = boxes.groupBy(*keys).agg(
        F.exp(F.avg(F.log(wide))).alias("_cw"), F.exp(F.avg(F.log(high))).alias("_ch"),
        F.max(wide).alias("_wide"), F.max(high).alias("_high"), (F.count("*") <= few).alias("_few"), *more)
    most = (F.col("_wide") / F.col("_cw") + 2) * (F.col("_high") / F.col("_ch") + 2)
    return sizes.withColumn("_coarse", most > MOST_CELLS).drop("_wide", "_high")


def in_cells(boxes: DataFrame) -> DataFrame:
    """A row for every cell of reaching boxes that carry their group's cell size."""
    at = lambda edge, size: F.when(F.col("_few"), 0).otherwise(F.floor(F.col(edge) / F.col(size)))
    placed = boxes.withColumns({"_x": at("_gx0", "_cw"), "_y": at("_gy0", "_ch"),
                                "_nx": at("_gx1", "_cw") - at("_gx0", "_cw"), "_ny": at("_gy1", "_ch") - at("_gy0", "_ch")})
    small = (F.col("_nx").cast("double") + 1) * (F.col("_ny").cast("double") + 1) <= MOST_CELLS
    cell = lambda level, x, y: F.struct(F.lit(level).alias("l"), x.alias("x"), y.alias("y"))
    zero = F.lit(0).cast("bigint")
    rows = lambda x: F.transform(F.sequence(F.col("_y"), F.col("_y") + F.col("_ny")), lambda y: cell(0, x, y))
    fine = F.flatten(F.transform(F.sequence(F.col("_x"), F.col("_x") + F.col("_nx")), rows))
    whole = F.array(cell(1, zero, zero))
    one = F.array(cell(0, zero, zero))
    cells = F.when(F.col("_few"), one).when(~small, whole).when(F.col("_coarse"), F.concat(fine, whole)).otherwise(fine)
    return (placed.withColumn("_own", F.when(small, 0).otherwise(1)).withColumn("_c", F.explode(cells))
            .withColumns({"_level": F.col("_c.l"), "_cx": F.col("_c.x"), "_cy": F.col("_c.y")})
            .drop("_c", "_nx", "_ny", "_cw", "_ch", "_coarse", "_few", *REACH))


def meeting(left: str, right: str, keys: list[str]) -> Column:
    """Join condition of two tables in cells: each pair of boxes that share a cell comes once."""
    l, r = (lambda name, side=side: F.col(f"{side}.{name}") for side in (left, right))
    on = F.lit(True)
    for name in [*keys, *CELL]:
        on = on & (l(name) == r(name))
    first = (l("_cx") == F.greatest(l("_x"), r("_x"))) & (l("_cy") == F.greatest(l("_y"), r("_y")))
    return on & (l("_level") == F.greatest(l("_own"), r("_own"))) & ((l("_level") == 1) | first)


def _stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One round of components: keys, u, v, child (an edge, else a root with itself), open (not a star yet).

    All steps are windows over what one shuffle by the keys dealt out.
    """
    node = Window.partitionBy(*keys, "u")
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    u, v, m = F.col("u"), F.col("v"), F.col("m")

    def spread(df: DataFrame, *pairs: Column) -> DataFrame:
        return df.select(*keys, F.explode(F.array_compact(F.array(*pairs))).alias("e")).select(*keys, "e.u", "e.v")

    both = spread(edges.repartition(*keys).distinct(), pair(u, v), pair(v, u))
    large = both.withColumn("m", F.least(u, F.min("v").over(node))).filter("v > u").select(*keys, v.alias("u"), m.alias("v")).distinct()
    small = spread(large.withColumn("m", F.min("v").over(node)), pair(u, m), F.when(v != m, pair(v, m))).distinct()
    ends = small.select(*keys, F.explode(F.array(
        F.struct(u.alias("u"), v.alias("v"), F.lit(True).alias("child")), F.struct(v.alias("u"), v.alias("v"), F.lit(False).alias("child")))).alias("e")).select(*keys, "e.*")
    return ends.distinct().withColumn("open", F.count("*").over(node) > 1)


def components(edges: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """Components of edges (keys, u, v), whole numbers: keys, node, root (the smallest) of every node that has an edge.

    Nodes are linked to the smallest they see, and the links of what they were
    linked to go along, so the rounds grow with the logarithm of a component's
    length. Each round is written, so lineage stays short.
    """
    edges = edges.select(*keys, F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u > v")
    for _ in range(rounds):
        stars = materialize(_stars(edges, keys), free=True)
        if stars.filter("open").isEmpty():
            return stars.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        edges = stars.filter("child").select(*keys, "v", "u")
    raise RuntimeError("components did not settle")
