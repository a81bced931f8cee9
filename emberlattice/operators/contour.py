"""Outlines of sets of lattice cells: shells and holes as closed rings of corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.functions import projection as P
from emberlattice.operators.graph import lattice_components
from emberlattice.scratch import Scratch

#: Directions of an edge, counter-clockwise: 0 east, 1 north, 2 west, 3 south. The set lies to the left.
HALF = 1 << 28


def edge_name(i: Column, j: Column, way: Column) -> Column:
    """A number for the run that leaves a corner in a direction; corners lie within 2^28 of the origin."""
    return ((i.cast("long") + HALF) * (2 * HALF) + (j.cast("long") + HALF)) * 4 + way


def boundary_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, way, si, sj, ei, ej): the straight stretches of the boundary of each key's cells (i to the east, j to the north), from their start to their end corner.

    A cell's edge belongs to the boundary if its neighbour on that side is missing; neighbours come from the order along its row and its column."""
    row, col = Window.partitionBy(*keys, "j").orderBy("i"), Window.partitionBy(*keys, "i").orderBy("j")
    missing = lambda at, step: F.coalesce(at != step, F.lit(True))
    own = cells.withColumns({"e": missing(F.lead("i").over(row), F.col("i") + 1), "w": missing(F.lag("i").over(row), F.col("i") - 1)})
    own = own.withColumns({"n": missing(F.lead("j").over(col), F.col("j") + 1), "s": missing(F.lag("j").over(col), F.col("j") - 1)})
    i, j = F.col("i"), F.col("j")
    sides = [("s", 0, j, i), ("e", 1, i + 1, j), ("n", 2, j + 1, i), ("w", 3, i, j)]
    edges = F.array_compact(F.array(*(F.when(F.col(side), F.struct(F.lit(way).alias("way"), line.cast("long").alias("line"), at.cast("long").alias("at"))) for side, way, line, at in sides)))
    flat = own.select(*keys, F.explode(edges).alias("edge")).select(*keys, "edge.*")
    along = Window.partitionBy(*keys, "way", "line").orderBy("at")
    runs = flat.withColumn("island", F.col("at") - F.row_number().over(along)).groupBy(*keys, "way", "line", "island").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    way, line, lo, hi = (F.col(c) for c in ("way", "line", "lo", "hi"))
    flat_way, forward = way.isin(0, 2), way.isin(0, 1)
    start, end = F.when(forward, lo).otherwise(hi), F.when(forward, hi).otherwise(lo)
    return runs.select(
        *keys, "way", F.when(flat_way, start).otherwise(line).alias("si"), F.when(flat_way, line).otherwise(start).alias("sj"),
        F.when(flat_way, end).otherwise(line).alias("ei"), F.when(flat_way, line).otherwise(end).alias("ej"),
    )


def followers(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds name and next: each run's number and that of the run after it. Two runs leave a corner where cells meet by their corners only; there the
    boundary turns right, so that an outline and a hole, or two holes, that touch stay rings of their own."""
    bit = lambda way: F.call_function("shiftleft", F.lit(1), way)
    here = runs.groupBy(*keys, F.col("si").alias("ei"), F.col("sj").alias("ej")).agg(F.bit_or(bit(F.col("way"))).alias("leaving"))
    right = (F.col("way") + 3) % 4
    turn = F.when(F.col("leaving").bitwiseAND(bit(right)) != 0, right).otherwise((F.col("way") + 1) % 4)
    met = runs.join(here, [*keys, "ei", "ej"])
    return met.select(*keys, "si", "sj", "ei", "ej", edge_name(F.col("si"), F.col("sj"), F.col("way")).alias("name"), edge_name(F.col("ei"), F.col("ej"), turn).alias("next"))


def ranked_on_rings(linked: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys, name, low, ahead): the least name on each run's ring, and how many steps ahead it lies. Pointers double each round, so rounds grow
    with the logarithm of the longest ring's runs; a round that finds nothing lower has seen whole rings."""
    now = scratch.keep(linked.select(*keys, "name", "next", F.col("name").alias("low"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("lower")), "pointers-0")
    k = 0
    while not now.filter("lower").isEmpty():
        there = now.select(*keys, F.col("name").alias("next"), F.col("next").alias("after"), F.col("low").alias("there_low"), F.col("ahead").alias("there_ahead"))
        lower = F.col("there_low") < F.col("low")
        after = now.join(there, [*keys, "next"]).select(
            *keys, "name", F.col("after").alias("next"), F.least("low", "there_low").alias("low"),
            F.when(lower, F.col("there_ahead") + (1 << k)).otherwise(F.col("ahead")).alias("ahead"), lower.alias("lower"),
        )
        now = scratch.keep(after, f"pointers-{k + 1}")
        scratch.drop(f"pointers-{k}")
        k += 1
    return now.select(*keys, "name", "low", "ahead")


def rings(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, piece, ring, twice_area, length, corners): the rings around each key's cells (keys, i, j; i to the east, j to the north) as closed arrays of corners
    (i, j), where cell (0, 0) has the corners (0, 0) and (1, 1).

    Cells that touch along an edge make a piece; a piece has one shell, counter-clockwise (twice_area above 0), and a hole, clockwise (below 0), for
    each gap in it. No ring visits a corner twice. Repeated cells count once; a cell with a null key or place is left out.
    """
    scratch = Scratch(cells.sparkSession, "rings")
    own_keys = [f"key_{n}" for n in range(len(keys))]  # whatever the keys' names, none clashes
    own = cells.select(*(F.col(k).alias(n) for k, n in zip(keys, own_keys)), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).dropna()
    pieces = lattice_components(own.select(*own_keys, F.col("i").alias("cx"), (-F.col("j")).alias("cy")), 4, keys=own_keys)
    every = [*own_keys, "piece"]
    placed = pieces.select(*own_keys, F.col("number").alias("piece"), F.col("cx").cast("long").alias("i"), (-F.col("cy")).cast("long").alias("j"))
    linked = scratch.keep(followers(boundary_runs(placed, every), every), "runs")
    ranked = ranked_on_rings(linked, every, scratch).join(linked, [*every, "name"])
    si, sj, ei, ej = (F.col(c) for c in ("si", "sj", "ei", "ej"))
    # from the least run on: it lies 0 steps ahead of itself, its follower one step less than the whole ring
    order = F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead"))
    found = ranked.groupBy(*every, "low").agg(
        F.sum(si * ej - ei * sj).alias("twice_area"),
        F.sum(F.abs(ei - si) + F.abs(ej - sj)).alias("length"),
        F.sort_array(F.collect_list(F.struct(order.alias("at"), si.alias("i"), sj.alias("j")))).alias("turns"),
    )
    corners = F.transform("turns", lambda t: F.struct(t["i"].alias("i"), t["j"].alias("j")))
    named = [F.col(n).alias(k) for k, n in zip(keys, own_keys)]
    return found.select(*named, "piece", F.col("low").alias("ring"), "twice_area", "length", F.concat(corners, F.slice(corners, 1, 1)).alias("corners"))


def polygons(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, polygons): for each key an array of polygons, each an array of rings of corners (i, j), the shell first, holes and polygons in the order of
    their first corners."""
    shell = F.struct((F.col("twice_area") < 0).alias("hole"), F.col("corners"))
    piece = rings(cells, keys).groupBy(*keys, "piece").agg(F.transform(F.sort_array(F.collect_list(shell)), lambda r: r["corners"]).alias("rings"))
    return piece.groupBy(*keys).agg(F.sort_array(F.collect_list("rings")).alias("polygons"))


def lattice_polygons(cells: DataFrame, d: float, keys: list[str]) -> DataFrame:
    """polygons of cells (keys, cx, cy; cy downwards) on a lattice of step d whose cell (0, 0) has its centre at (min_x, max_y), in metres."""
    named = polygons(cells.select(*keys, F.col("cx").alias("i"), (-F.col("cy")).alias("j")), keys)
    origin = cells.groupBy(*keys).agg(F.first("min_x").alias("min_x"), F.first("max_y").alias("max_y"))
    at = lambda p: F.struct((F.col("min_x") + (p["i"] - 0.5) * d).alias("x"), (F.col("max_y") + (p["j"] - 0.5) * d).alias("y"))
    return named.join(origin, list(keys)).select(*keys, F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, at))).alias("polygons"))


def to_degrees(shapes: DataFrame, srid: str = "srid") -> DataFrame:
    """polygons in metres of the zone in the srid column as longitudes and latitudes (EPSG:4326)."""

    def back(p: Column) -> Column:
        lon, lat = P.utm_inverse(p["x"], p["y"], F.col(srid))
        return F.struct(lon.alias("x"), lat.alias("y"))

    return shapes.withColumn("polygons", F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, back))))
