"""Tables of a page from what it draws, without a detector's library: ruled lines to crossings, crossings to cells, cells
that meet to tables.

Drawn lines and boxes are rows (keys of the page, x0, y0, x1, y1), in points, y downwards. Every step keeps rows of a page
apart by its keys; a page's rules are dealt into bands, so crossings are looked for only where two rules can meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import components, kept
from quire.operators.pages import table_likeness

#: Points within which positions count as one, ends as touching; shortest rule; height of a band.
SNAP, SHORTEST, BAND = 3.0, 3.0, 72.0
#: Fixed values of likeness: slant and length of a ruled line, width of a bucket of left edges, blocks that make a column.
STRAIGHT, LONG, BUCKET, IN_COLUMN = 1.0, 30.0, 6.0, 3
#: An edge's number is its position's, times this, plus that of its piece: numbers ascend with positions.
PIECES = 100_000


def rules(lines: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, upright, at, lo, hi): straight lines, the sides of boxes, and boxes that are thin enough to be lines."""
    ordered = lambda df: df.select(
        *keys, F.least("x0", "x1").cast("double").alias("x0"), F.least("y0", "y1").cast("double").alias("y0"), F.greatest("x0", "x1").cast("double").alias("x1"), F.greatest("y0", "y1").cast("double").alias("y1")
    )
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    edge = lambda upright, at, lo, hi: F.struct(F.lit(upright).alias("upright"), at.alias("at"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    level, upright = edge(False, (F.col("y0") + F.col("y1")) / 2, "x0", "x1"), edge(True, (F.col("x0") + F.col("x1")) / 2, "y0", "y1")
    none = F.array().cast("array<struct<upright: boolean, at: double, lo: double, hi: double>>")
    of_line = F.when((high < STRAIGHT) & (wide >= SHORTEST), F.array(level)).when((wide < STRAIGHT) & (high >= SHORTEST), F.array(upright)).otherwise(none)
    sides = F.array(edge(False, F.col("y0"), "x0", "x1"), edge(False, F.col("y1"), "x0", "x1"), edge(True, F.col("x0"), "y0", "y1"), edge(True, F.col("x1"), "y0", "y1"))
    of_box = F.when((wide > SNAP) & (high > SNAP), sides).when(wide > SNAP, F.array(level)).when(high > SNAP, F.array(upright)).otherwise(none)
    each = ordered(lines).select(*keys, F.explode(of_line).alias("e")).unionByName(ordered(boxes).select(*keys, F.explode(of_box).alias("e")))
    return each.select(*keys, "e.*")


def edges(ruled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, upright, edge, at, lo, hi): rules at one position that touch or overlap, as one edge."""
    along = Window.partitionBy(*keys, "upright").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(along) > SNAP, F.lit(True))
    placed = ruled.withColumn("place", F.sum(apart.cast("long")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = Window.partitionBy(*keys, "upright", "place").orderBy("lo", "hi")
    before = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    piece = F.sum(F.coalesce(F.col("lo") > before + SNAP, F.lit(False)).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = placed.withColumn("before", before).withColumn("piece", piece)
    return cut.groupBy(*keys, "upright", (F.col("place") * PIECES + F.col("piece")).alias("edge")).agg(F.min("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def crossings(edged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, v, x, y, on, down): where a level and an upright edge meet, and whether they go on to the right and below."""
    band = lambda c: F.floor(c / BAND)
    level = edged.where("NOT upright").select(*keys, F.col("edge").alias("h"), F.col("at").alias("y"), F.col("lo").alias("left"), F.col("hi").alias("right"), band(F.col("at")).alias("band"))
    upright = edged.where("upright").select(
        *keys, F.col("edge").alias("v"), F.col("at").alias("x"), F.col("lo").alias("top"), F.col("hi").alias("bottom"),
        F.explode(F.sequence(band(F.col("lo") - SNAP), band(F.col("hi") + SNAP))).alias("band"),
    )
    meet = F.col("x").between(F.col("left") - SNAP, F.col("right") + SNAP) & F.col("y").between(F.col("top") - SNAP, F.col("bottom") + SNAP)
    both = level.join(upright, [*keys, "band"]).where(meet)
    return both.select(*keys, "h", "v", "x", "y", (F.col("right") > F.col("x") + SNAP).alias("on"), (F.col("bottom") > F.col("y") + SNAP).alias("down"))


def cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, v, h2, v2, x, y): the smallest boxes between crossings, by the edges above, left, below and right.

    From its upper left corner a cell reaches to the next crossing on the right from which an edge goes down, and to the
    next below from which one goes right; it is a cell if these two edges meet.
    """
    ahead = lambda by: Window.partitionBy(*keys, by).rowsBetween(1, Window.unboundedFollowing)
    right = F.min(F.when(F.col("down"), F.col("v"))).over(ahead("h").orderBy("v"))
    below = F.min(F.when(F.col("on"), F.col("h"))).over(ahead("v").orderBy("h"))
    corner = points.withColumn("v2", right).withColumn("h2", below).where("v2 IS NOT NULL AND h2 IS NOT NULL")
    there = points.select(*keys, F.col("h").alias("h2"), F.col("v").alias("v2"))
    return corner.join(there, [*keys, "h2", "v2"], "left_semi").select(*keys, "h", "v", "h2", "v2", "x", "y")


def tables(lines: DataFrame, boxes: DataFrame, keys: list[str], least_cells: int = 2) -> DataFrame:
    """(keys, nth, x0, y0, x1, y1, n_cells, n_rows, n_columns): every table of every page, from above.

    A table is a set of cells that share corners; a box on its own is none. Rows and columns are the distinct upper and left
    edges of its cells.
    """
    edged = kept(edges(rules(lines, boxes, keys), keys))
    found = cells(crossings(edged, keys), keys)
    # Cells of a row that follow one another share their corners: such a run is one node, named by its first corner (edge
    # numbers are those of a page, so the name carries the page's keys); runs are linked where corners of theirs meet.
    row = Window.partitionBy(*keys, "h", "h2").orderBy("v")
    breaks = F.coalesce(F.lag("v2").over(row) != F.col("v"), F.lit(True))
    runs = found.withColumn("first", F.last(F.when(breaks, F.col("v")), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    name = F.to_json(F.struct(*keys, "h", "h2", "first"))
    named = kept(runs.withColumn("own", name))
    corner = lambda h, v: F.struct(F.col(h).alias("h"), F.col(v).alias("v"))
    met = named.select(*keys, "own", F.explode(F.array(corner("h", "v"), corner("h", "v2"), corner("h2", "v"), corner("h2", "v2"))).alias("at")).distinct()
    least = met.groupBy(*keys, "at").agg(F.min("own").alias("other"))
    of = components(met.join(least, [*keys, "at"]), "own", "other")
    at = edged.select(*keys, "upright", "edge", "at")
    ends = lambda upright, edge, end: at.where(F.col("upright") == upright).select(*keys, F.col("edge").alias(edge), F.col("at").alias(end))
    placed = named.join(ends(True, "v2", "x1"), [*keys, "v2"]).join(ends(False, "h2", "y1"), [*keys, "h2"]).join(of, F.col("own") == F.col("node"), "left")
    each = placed.withColumn("component", F.coalesce("component", "own")).groupBy(*keys, "component").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count("*").alias("n_cells"), F.countDistinct("h").alias("n_rows"), F.countDistinct("v").alias("n_columns"),
    ).where(F.col("n_cells") >= least_cells)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "y1", "x1"))
    return each.withColumn("nth", nth).select(*keys, "nth", "x0", "y0", "x1", "y1", "n_cells", "n_rows", "n_columns")


def ruled_lines(lines: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rules): long straight lines of a page; a large box counts as four."""
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    long = ((high < STRAIGHT) & (wide > LONG)) | ((wide < STRAIGHT) & (high > LONG))
    drawn = lines.select(*keys, long.cast("int").alias("n")).unionByName(boxes.select(*keys, F.when((wide > LONG) & (high > LONG), 4).otherwise(0).alias("n")))
    return drawn.groupBy(*keys).agg(F.sum("n").alias("rules"))


def shared_columns(blocks: DataFrame, keys: list[str], left: str = "x0") -> DataFrame:
    """(keys, columns): how many left edges, in buckets, at least three text blocks of a page share."""
    bucket = (F.col(left) / BUCKET).cast("long")
    return blocks.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= IN_COLUMN).groupBy(*keys).agg(F.count("*").alias("columns"))


def page_tables(pages: DataFrame, lines: DataFrame, boxes: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """pages with table_count, table_cells and likeness; pages that draw nothing have zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = tables(lines, boxes, keys).groupBy(*keys).agg(F.count("*").alias("table_count"), F.sum("n_cells").alias("table_cells"))
    out = pages.join(counted, keys, "left").join(ruled_lines(lines, boxes, keys), keys, "left").join(shared_columns(blocks, keys), keys, "left")
    score: Column = table_likeness(zero(F.col("rules")), zero(F.col("columns")))
    return out.withColumns({"table_count": zero(F.col("table_count")), "table_cells": zero(F.col("table_cells")), "likeness": score}).drop("rules", "columns")
