"""Joins of ranges and of boxes without comparing all pairs of a page.

A page may be hot: all of a corpus's lines may stand on one. So nothing here gathers a page. Ranges are swept in blocks of
positions, boxes meet in cells of a grid, and what a window or a cell holds is bounded by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one block of a sweep.
BLOCK = 4096
#: Positions of one cell that ranges on a line meet in.
CELL = 16
#: Side of the finest grid's cells; each coarser grid has cells twice as wide.
SIDE = 16.0
LEVELS = 24
KEYS = ("doc_id", "page")


def touched(asked: DataFrame, rules: DataFrame, keys: tuple[str, ...] = KEYS, block: int = BLOCK) -> DataFrame:
    """asked with touched: whether some range of rules with the same keys overlaps [start, stop); ranges that only meet do not.

    A sort-merge sweep. A rule's range [a, b) overlaps if a < stop and start < b, that is, if the greatest b of all rules with a
    < stop is beyond start. That is a running maximum in the order of positions: within blocks of positions by a window over distinct
    positions, and over the blocks before by their own maxima. Ranges at one position are brought together before
    they are shuffled, and rows with null keys overlap nothing. The work grows as the rows, not as pairs.
    """
    at = [F.col(k) for k in keys]
    opened = rules.select(*keys, F.col("start").cast("long").alias("_at"), F.col("stop").cast("long").alias("_reach")).groupBy(*keys, "_at").agg(F.max("_reach").alias("_reach"))
    places = asked.select(*keys, F.col("stop").cast("long").alias("_at")).distinct()
    events = opened.withColumn("_rule", F.lit(1)).unionByName(places.withColumn("_reach", F.lit(None).cast("long")).withColumn("_rule", F.lit(0))).withColumn("_block", F.floor(F.col("_at") / block))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = opened.groupBy(*keys, F.floor(F.col("_at") / block).alias("_block")).agg(F.max("_reach").alias("_own"))
    blocks = events.select(*keys, "_block").distinct().join(carried, [*keys, "_block"], "left").select(*keys, "_block", F.max("_own").over(ahead).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy("_at", "_rule").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("_within", F.max("_reach").over(within)).filter("_rule = 0").join(blocks, [*keys, "_block"], "left")
    reached = swept.select(*keys, "_at", F.greatest("_within", "_before").alias("_reached"))
    joined = asked.withColumn("_at", F.col("stop").cast("long")).join(reached, [*keys, "_at"], "left")
    known = F.lit(True)
    for k in at:
        known = known & k.isNotNull()
    return joined.withColumn("touched", known & F.coalesce(F.col("_reached") > F.col("start"), F.lit(False))).select(*asked.columns, "touched")


def boxes_covering(hits: DataFrame, tokens: DataFrame, keys: tuple[str, ...] = (*KEYS, "line")) -> DataFrame:
    """hits with box: the union of the boxes of the tokens on their line that touch [start, stop), null where none does.

    hits: keys, hit (its number), start, stop; tokens: keys, start, stop, box (x, y, w, h). Both meet in cells of CELL
    positions; minima and maxima do not mind a token that is met in two cells, so pairs need not be made distinct.
    """
    def cells(start: Column, stop: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / CELL), F.greatest(F.floor(start / CELL), F.floor((stop - 1) / CELL))))

    asked = hits.select(*keys, "hit", F.col("start").alias("_a"), F.col("stop").alias("_b"), cells(F.col("start"), F.col("stop")).alias("_cell"))
    held = tokens.select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"), "box", cells(F.col("start"), F.col("stop")).alias("_cell"))
    met = asked.join(held, [*keys, "_cell"]).filter((F.col("_s") < F.col("_b")) & (F.col("_a") < F.col("_e")))
    edges = met.groupBy(*keys, "hit").agg(F.min("box.x").alias("x"), F.min("box.y").alias("y"), F.max(F.col("box.x") + F.col("box.w")).alias("r"), F.max(F.col("box.y") + F.col("box.h")).alias("b"))
    whole = F.struct("x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))
    return hits.join(edges.select(*keys, "hit", whole.alias("box")), [*keys, "hit"], "left").select(*hits.columns, "box")


def meets(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (outer["x"] + outer["w"] >= inner["x"] + inner["w"]) & (outer["y"] + outer["h"] >= inner["y"] + inner["h"])


def agrees(read: Column, drawn: Column) -> Column:
    """Whether a drawn box meets a read one and is at most half again as large."""
    return meets(read, drawn) & (drawn["w"] <= 1.5 * read["w"]) & (drawn["h"] <= 1.5 * read["h"])


def _level(box: Column) -> Column:
    """The finest grid whose cells are no smaller than the box: it lies in four cells at most."""
    size = F.greatest(box["w"], box["h"], F.lit(SIDE))
    return F.least(F.ceil(F.log2(size / SIDE)), F.lit(LEVELS)).cast("int")


def met_boxes(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, a, b: all pairs of boxes of a page that meet or of which one holds the other, each pair once.

    left has keys and a, right keys and b: structs with a field box (x, y, w, h) and whatever else the caller wants back.
    A hierarchy of grids: a box goes to the cells of the grid that fits it, and of all coarser ones that boxes of the
    other side are in. Two boxes meet in the grid of the larger one, in each cell that both are in; the pair counts where the
    cell holds the corner (greatest x, greatest y) of what they share. So a box is copied a bounded number of times
    whatever its size, and a page of small boxes is no quadratic work.
    """

    def placed(df: DataFrame, name: str, own: str) -> DataFrame:
        levelled = df.select(*keys, name, _level(F.col(f"{name}.box")).alias(own)).filter(F.col(f"{name}.box").isNotNull())
        each = levelled.withColumn("_grid", F.explode(F.sequence(F.col(own), F.lit(LEVELS))))
        return each.withColumn("_side", F.lit(SIDE) * F.pow(F.lit(2.0), F.col("_grid")))

    def in_cells(df: DataFrame, name: str) -> DataFrame:
        def span(low: str, size: str) -> Column:
            return F.explode(F.sequence(F.floor(F.col(f"{name}.box.{low}") / F.col("_side")), F.floor((F.col(f"{name}.box.{low}") + F.col(f"{name}.box.{size}")) / F.col("_side"))))

        return df.withColumn("_cx", span("x", "w")).withColumn("_cy", span("y", "h")).drop("_side")

    a, b = placed(left, "a", "_la"), placed(right, "b", "_lb")
    # Of the coarser grids only those that the other side has boxes of: a handful, known by a small aggregate.
    grids = sorted({r[0] for df, own in ((left, "a"), (right, "b")) for r in df.select(_level(F.col(f"{own}.box")).alias("g")).filter("g is not null").distinct().collect()})
    a, b = (in_cells(x.filter(F.col("_grid").isin(*grids)), n) for x, n in ((a, "a"), (b, "b"))) if grids else (in_cells(a, "a"), in_cells(b, "b"))
    pairs = a.join(b, [*keys, "_grid", "_cx", "_cy"]).filter(F.col("_grid") == F.greatest("_la", "_lb"))
    x, y = F.col("a.box"), F.col("b.box")
    side = F.lit(SIDE) * F.pow(F.lit(2.0), F.col("_grid"))
    here = (F.floor(F.greatest(x["x"], y["x"]) / side) == F.col("_cx")) & (F.floor(F.greatest(x["y"], y["y"]) / side) == F.col("_cy"))
    return pairs.filter(here & (meets(x, y) | contains(x, y) | contains(y, x))).select(*keys, "a", "b")
