"""Nearest edges over a pyramid of cells that is split by counts, each cell with the box of what it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.scratch import Scratch

#: Edges of a cell that isn't split further, at most (more only where they are as long as the cell, or closer than the finest cells).
LEAF = 16
#: A cell has FAN x FAN cells of the next finer exponent; the finest ones have an exponent of -DEPTH.
FAN, DEPTH = 4, 8
BITS = 2
#: Upper levels of the pyramid with no more cells than this are sent whole to the tasks.
SENT = 2048
#: After so many levels the front is written.
CUT = 3
SLACK = 1 + 1e-9
BOX = ("x0", "y0", "x1", "y1")


def lifted(c: str, by: Column | int) -> Column:
    return F.call_function("shiftright", F.col(c), (F.lit(by) if isinstance(by, int) else by) * BITS)


def boxes(*own: Column) -> list[Column]:
    x0, y0, x1, y1 = own or (F.col(c) for c in BOX)
    return [F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")]


def held_edges(edges: DataFrame, size: float, top: int, lo_x: float, lo_y: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """Edges (layer, ax, ay, bx, by) with their cell (e, cx, cy), the one around their middle whose side is size * FAN ** e, and the least e.

    An edge longer than `size` lies in a cell as wide as it is long; a cell with more than LEAF shorter ones is split, and those fit for a finer
    cell go on. So an edge has one row, whatever its length."""
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    fit = F.when(length > 0, F.ceil(F.log2(length / size) / BITS)).otherwise(-DEPTH)
    fine = lambda a, b, lo: F.greatest(F.floor(((F.col(a) + F.col(b)) / 2 - lo) / size * float(FAN**DEPTH)).cast("long"), F.lit(0).cast("long"))
    own = edges.select("layer", "ax", "ay", "bx", "by").withColumns({
        "fit": F.least(F.greatest(fit, F.lit(-DEPTH)), F.lit(top - 1)).cast("int"), "fx": fine("ax", "bx", lo_x), "fy": fine("ay", "by", lo_y)
    })
    at = lambda df, e: df.withColumns({"e": e.cast("int"), "cx": lifted("fx", e + DEPTH), "cy": lifted("fy", e + DEPTH)})
    key = ["layer", "cx", "cy"]
    done, now, e = [at(own.filter("fit > 0"), F.col("fit"))], own.filter("fit <= 0"), 0
    while True:
        here = at(now, F.lit(e))
        if e == -DEPTH:
            done.append(here)
            break
        crowded = scratch.keep(here.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).drop("n"), f"crowded{-e}")
        done.append(here.join(crowded, key, "left_anti"))
        if crowded.isEmpty():
            break
        split = here.join(crowded, key, "left_semi")
        done.append(split.filter(F.col("fit") == e))
        now = scratch.keep(split.filter(F.col("fit") < e).drop("e", "cx", "cy"), f"level{-e}")
        e -= 1
    return reduce(DataFrame.unionByName, done).select("layer", "e", "cx", "cy", "ax", "ay", "bx", "by"), e


def links(held: DataFrame, top: int) -> DataFrame:
    """(layer, e, cx, cy, kids): what is right below each cell that has something below it: cells, and lists of edges (own), each with its box."""
    key = ["layer", "e", "cx", "cy"]
    ends = [f(a, b) for f in (F.least, F.greatest) for a, b in (("ax", "bx"), ("ay", "by"))]
    lists = held.groupBy(*key).agg(*boxes(*ends))
    up = F.explode(F.sequence(F.col("e") + 1, F.lit(top))).alias("up")
    above = lists.select(*key, *BOX, up)
    cells = above.groupBy("layer", F.col("up").alias("e"), lifted("cx", F.col("up") - F.col("e")).alias("cx"), lifted("cy", F.col("up") - F.col("e")).alias("cy")).agg(*boxes())
    every = lists.withColumn("own", F.lit(True)).unionByName(cells.filter(F.col("e") < top).withColumn("own", F.lit(False)))
    kid = F.struct("own", "e", "cx", "cy", *BOX)
    return every.groupBy("layer", (F.col("e") + 1).alias("up"), lifted("cx", 1).alias("ux"), lifted("cy", 1).alias("uy")).agg(F.collect_list(kid).alias("kids"))


def bounds() -> tuple[Column, Column]:
    """Squared distances from a point to a box: within which nothing in it lies, and within which something does, as each of its sides is touched."""
    x, y, x0, y0, x1, y1 = (F.col(c) for c in ("x", "y", *BOX))
    square = lambda c: c * c
    least = square(F.greatest(x0 - x, F.lit(0.0), x - x1)) + square(F.greatest(y0 - y, F.lit(0.0), y - y1))
    side = lambda v, a, b: F.least(F.abs(v - a), F.abs(v - b))
    far = lambda v, a, b: F.greatest(F.abs(v - a), F.abs(v - b))
    most = F.least(square(side(x, x0, x1)) + square(far(y, y0, y1)), square(far(x, x0, x1)) + square(side(y, y0, y1)))
    return least, most


def first_bounds(asking: DataFrame, tree: DataFrame, size: float, top: int, lowest: int, lo_x: float, lo_y: float) -> DataFrame:
    """Askers with u2, the squared distance within which something of the cells around them is sure to lie; infinite where all of these are empty."""
    fine = lambda c, lo: F.floor((F.col(c) - lo) / size * float(FAN**DEPTH)).cast("long")
    up = F.explode(F.sequence(F.lit(lowest), F.lit(top - 1))).alias("e")
    at = asking.select("id", "layer", "x", "y", up, fine("x", lo_x).alias("fx"), fine("y", lo_y).alias("fy"))
    at = at.select("id", "layer", "x", "y", "e", lifted("fx", F.col("e") + DEPTH).alias("cx"), lifted("fy", F.col("e") + DEPTH).alias("cy"))
    near = at.join(tree.select("layer", F.inline("kids")), ["layer", "e", "cx", "cy"]).groupBy("id", "layer").agg(F.min(bounds()[1]).alias("u2"))
    return asking.join(near, ["id", "layer"], "left").withColumn("u2", F.coalesce("u2", F.lit(float("inf"))))


def fronts(asking: DataFrame, tree: DataFrame, layers: int, top: int, lowest: int, scratch: Scratch) -> DataFrame:
    """(id, layer, x, y, u2, own, e, cx, cy) of the lists of edges that each asker (id, layer, x, y, u2) must open.

    All start at the top. In each round an asker's cells give way to what lies right below them; the least distance within which something is sure to lie
    closes all that is farther away."""
    none = F.lit(0).cast("long")
    ask = ["id", "layer", "x", "y", "u2"]
    front = asking.select(*ask, F.lit(False).alias("own"), F.lit(top).alias("e"), none.alias("cx"), none.alias("cy"), *(F.lit(0.0).alias(c) for c in BOX))
    me = F.struct("own", "e", "cx", "cy", *BOX)
    least, most = bounds()
    for level in range(top, lowest, -1):
        below = tree.filter(F.col("up") == level).select("layer", F.col("ux").alias("cx"), F.col("uy").alias("cy"), "kids")
        if layers * FAN ** (2 * (top - level)) <= SENT:  # as many cells as there can be at this level
            below = F.broadcast(below)
        met = front.join(below, ["layer", "cx", "cy"], "left")
        met = met.select(*ask, F.explode(F.when(F.col("own"), F.array(me)).otherwise(F.col("kids"))).alias("k")).select(*ask, "k.*").filter(least <= F.col("u2") * SLACK)
        sure = F.least("u2", F.min(most).over(Window.partitionBy("id", "layer")))
        front = met.withColumn("u2", sure).filter(least <= F.col("u2") * SLACK)
        if (top - level) % CUT == CUT - 1 and level - 1 > lowest:
            front = scratch.keep(front, f"front{top - level}")
    return front.drop(*BOX)


def nearest_edges(asking: DataFrame, edges: DataFrame, box: tuple, layers: int, size: float, d2: Column) -> DataFrame:
    """(id, layer, distance): the least distance from each asker (id, layer, x, y; finite) to the edges (layer, ax, ay, bx, by; finite, different ones) of its
    layer, by the squared distance d2 over these columns. A layer without edges gives no rows.

    box: the least and largest middle of the edges (x, y, x, y); layers: how many there are; `size`, about the usual length of an edge, is a hint and changes no
    result. No tile is met whole: a search opens the lists of at most about LEAF edges that its bound leaves open, far from all edges too. A long edge has one row.
    """
    scratch = Scratch(edges.sparkSession, "pyramid")
    lo_x, lo_y, wide = box[0], box[1], max(box[2] - box[0], box[3] - box[1])
    size = max(size, wide * 2.0**-40)  # cells' numbers stay far below 2 ** 63
    top = 1
    while size * FAN**top <= wide:
        top += 1
    held, lowest = held_edges(edges, size, top, lo_x, lo_y, scratch)
    held = scratch.keep(held, "held")
    tree = scratch.keep(links(held, top), "links")
    asking = first_bounds(asking, tree, size, top, lowest, lo_x, lo_y)
    front = fronts(asking, tree, layers, top, lowest, scratch).filter("own")
    met = front.join(held, ["layer", "e", "cx", "cy"])
    return met.groupBy("id", "layer").agg(F.sqrt(F.min(d2)).alias("distance"))
