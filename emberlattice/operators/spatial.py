"""Spatial joins on tiles: nearest shapes, shapes within a distance, points in polygons."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.operators.pyramid import nearest_edges
from emberlattice.scratch import dealt, written


def tile(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a point to a segment (or to its one point)."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0)), F.lit(1.0)))
    ex, ey = ax + t * dx - px, ay + t * dy - py
    return ex * ex + ey * ey


def tiles_of_box(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, size: float) -> Column:
    """One struct (tx, ty) for each tile that a box touches."""
    xs, ys = F.sequence(tile(lo_x, size), tile(hi_x, size)), F.sequence(tile(lo_y, size), tile(hi_y, size))
    return F.explode(F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("tx"), j.alias("ty"))))))


def crossed(px: Column, py: Column, edges: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges (array of a, b)."""

    def crosses(e):
        up = (e["a"]["y"] > py) != (e["b"]["y"] > py)
        at = e["a"]["x"] + (py - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])
        return up & (px < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def inside_ring(px: Column, py: Column, ring: str) -> Column:
    """Even-odd test against a closed ring (array of x, y), a point on an edge counts as inside."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def on(e):
        cross = (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (px - e["a"]["x"])
        within = px.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"]))
        within &= py.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
        return (cross == 0) & within

    return crossed(px, py, edges) | F.exists(edges, on)


def segments(shapes: DataFrame, keys=("layer",)) -> DataFrame:
    """Edges of shapes (feature_id, geom_type, parts): (keys, feature_id, ax, ay, bx, by); a single point is an edge of no length."""
    part = shapes.filter(F.size("parts") > 0).select(*keys, "feature_id", F.explode("parts").alias("p")).filter(F.size("p") > 0)
    ends = F.when(F.size("p") == 1, F.array(F.struct(F.col("p")[0].alias("a"), F.col("p")[0].alias("b")))).otherwise(
        F.arrays_zip(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(1))).alias("a"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))).alias("b"))
    )
    edge = part.select(*keys, "feature_id", F.explode(ends).alias("e"))
    return edge.select(*keys, "feature_id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def nearest_distance(points: DataFrame, shapes: DataFrame, size: float, x: str = "longitude", y: str = "latitude", id_col: str = "point_id") -> DataFrame:
    """(id_col, layer, distance): least planar distance from each point to each layer's lines, points and polygons, 0 inside a polygon and
    not in its holes.

    Edges fill a pyramid of cells that are split by counts, so points near, in a crowd or far from everything open a few short lists (`pyramid`); `size` is
    a hint for the cells' width. A layer without shapes gives no rows (read it as 0). Points and edges with a missing or infinite coordinate take no part; of
    rows with one id, one counts.
    """
    finite = lambda *names: reduce(and_, ((F.abs(F.col(c)) < float("inf")) & ~F.isnan(F.col(c)) for c in names))
    own = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(finite("x", "y")).dropDuplicates(["id"])
    edges = written(segments(shapes).filter(finite("ax", "ay", "bx", "by")).select("layer", "ax", "ay", "bx", "by").distinct(), "edges")
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    *box, layers = edges.agg(F.min(mx), F.min(my), F.max(mx), F.max(my), F.collect_set("layer")).first()
    if not layers:
        return own.select(F.col("id").alias(id_col), F.lit("").alias("layer"), F.lit(0.0).alias("distance")).limit(0)
    inside = written(inside_layers(own, shapes, size), "inside")
    asking = own.withColumn("layer", F.explode(F.array(*(F.lit(v) for v in layers)))).join(inside, ["id", "layer"], "left_anti")
    d2 = segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    done = inside.select("id", "layer", F.lit(0.0).alias("distance")).unionByName(nearest_edges(asking, edges, tuple(box), len(layers), size, d2))
    return done.select(F.col("id").alias(id_col), "layer", "distance")


def inside_layers(own: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """(id, layer) of the points (id, x, y) inside one of a layer's polygons. A ring lies in at most four tiles, of a width fit for its box; a point
    asks once for each width there is."""
    areas = shapes.filter("geom_type = 'polygon'").select("layer", "feature_id", F.explode("parts").alias("ring")).filter(F.size("ring") > 3)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    areas = areas.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})
    long = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    areas = areas.filter(long < float("inf")).withColumn("e", F.when(long > size, F.ceil(F.log2(long / size))).otherwise(0).cast("int"))
    widths = sorted(r[0] for r in areas.select("e").distinct().collect())  # powers of two: a few dozen
    if not widths:
        return own.select("id", F.lit("").alias("layer")).limit(0)
    width = F.pow(F.lit(2.0), F.col("e")) * size
    number = lambda c: F.floor(F.col(c) / width).cast("long")
    tx, ty = F.explode(F.sequence(number("x0"), number("x1"))), F.explode(F.sequence(number("y0"), number("y1")))
    tiled = areas.withColumn("tx", tx).withColumn("ty", ty).select("layer", "feature_id", "ring", "x0", "y0", "x1", "y1", "e", "tx", "ty")
    at = own.withColumn("e", F.explode(F.array(*(F.lit(e) for e in widths)))).withColumns({"tx": number("x"), "ty": number("y")})
    pairs = dealt(at).join(dealt(tiled), ["e", "tx", "ty"]).filter("x between x0 and x1 and y between y0 and y1")
    # a hole's ring lies inside an outer one: an odd number of a shape's rings around a point means inside
    within = pairs.filter(inside_ring(F.col("x"), F.col("y"), "ring")).groupBy("id", "layer", "feature_id").count()
    return within.filter("count % 2 = 1").select("id", "layer").distinct()


def within_count(points: DataFrame, boxes: DataFrame, radius: float, x: str = "utm_x_m", y: str = "utm_y_m", id_col: str = "point_id") -> DataFrame:
    """(id_col, n): how many different shapes, given by their edges' boxes or as boxes (feature_id, lo_x, lo_y, hi_x, hi_y), come within
    the radius of each point; points with none are not there. Tiles as wide as the radius, each shape in all tiles it touches when grown by it."""
    grown = boxes.select("feature_id", "lo_x", "lo_y", "hi_x", "hi_y", tiles_of_box(F.col("lo_x") - radius, F.col("lo_y") - radius, F.col("hi_x") + radius, F.col("hi_y") + radius, 2 * radius).alias("t"))
    at = points.select(F.col(id_col), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumn("tx", tile(F.col("x"), 2 * radius)).withColumn("ty", tile(F.col("y"), 2 * radius))
    pairs = dealt(at).join(dealt(grown.select("*", "t.tx", "t.ty").drop("t")), ["tx", "ty"])
    dx = F.greatest(F.col("lo_x") - F.col("x"), F.lit(0.0), F.col("x") - F.col("hi_x"))
    dy = F.greatest(F.col("lo_y") - F.col("y"), F.lit(0.0), F.col("y") - F.col("hi_y"))
    return pairs.filter(dx * dx + dy * dy <= radius * radius).groupBy(id_col).agg(F.countDistinct("feature_id").alias("n"))


def touching_count(points: DataFrame, shapes: DataFrame, radius: float, x: str = "utm_x_m", y: str = "utm_y_m", id_col: str = "point_id", keys=()) -> DataFrame:
    """(id_col, n): how many different shapes (keys, feature_id, geom_type, parts) come within the radius of each point of the same keys, by
    the exact distance to their edges, 0 inside a polygon and not in its holes; points with none are not there.

    Boxes only deal parts to tiles: each part is in all tiles that its box touches when grown by the radius. A point is inside if it is inside an odd number of a shape's rings.
    """
    same = lambda p: F.transform(p, lambda v: F.struct(v.alias("a"), v.alias("b")))
    own = shapes.select(*keys, "feature_id", "geom_type", "parts").distinct().withColumn("shape", F.xxhash64("geom_type", "parts"))
    part = own.select(*keys, "feature_id", "shape", "geom_type", F.explode("parts").alias("p")).filter(F.size("p") > 0)
    joined = F.arrays_zip(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(1))).alias("a"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))).alias("b"))
    part = part.withColumn("edges", F.when((F.col("geom_type") == "point") | (F.size("p") == 1), same("p")).otherwise(joined)).withColumn("area", (F.col("geom_type") == "polygon") & (F.size("p") > 3))
    xs, ys = F.transform("p", lambda v: v["x"]), F.transform("p", lambda v: v["y"])
    boxes = part.select(*keys, "feature_id", "shape", "area", "edges", F.array_min(xs).alias("lo_x"), F.array_min(ys).alias("lo_y"), F.array_max(xs).alias("hi_x"), F.array_max(ys).alias("hi_y"))
    size, most = 2 * radius, radius * radius
    tiled = boxes.select("*", tiles_of_box(F.col("lo_x") - radius, F.col("lo_y") - radius, F.col("hi_x") + radius, F.col("hi_y") + radius, size).alias("t")).select("*", "t.tx", "t.ty").drop("t")
    px, py = F.col("x"), F.col("y")
    at = points.select(*keys, F.col(id_col), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns({"tx": tile(px, size), "ty": tile(py, size)})
    dx, dy = F.greatest(F.col("lo_x") - px, F.lit(0.0), px - F.col("hi_x")), F.greatest(F.col("lo_y") - py, F.lit(0.0), py - F.col("hi_y"))
    pairs = dealt(at).join(dealt(tiled), [*keys, "tx", "ty"]).filter(dx * dx + dy * dy <= most)
    near = F.exists("edges", lambda e: segment_distance2(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= most)
    inside = F.col("area") & crossed(px, py, F.col("edges"))
    met = pairs.select(id_col, "feature_id", "shape", near.alias("near"), inside.cast("int").alias("inside")).groupBy(id_col, "feature_id", "shape").agg(F.max("near").alias("near"), F.sum("inside").alias("rings"))
    return met.filter(F.col("near") | (F.col("rings") % 2 == 1)).groupBy(id_col).agg(F.countDistinct("feature_id").alias("n"))


def building_density(points: DataFrame, shapes: DataFrame, radius: float = 50.0, divisor: float = 10.0, id_col: str = "point_id", **names) -> DataFrame:
    """Adds building_density = count / divisor within 0..1 (0 where there is none); shapes have parts, or are boxes."""
    counts = (touching_count if "parts" in shapes.columns else within_count)(points, shapes, radius, id_col=id_col, **names)
    return points.join(counts, id_col, "left").withColumn("building_density", F.least(F.coalesce(F.col("n"), F.lit(0)) / divisor, F.lit(1.0))).drop("n")


def regular_grid(boundary: DataFrame, metres: float = 100.0, keys=("run_id",)) -> DataFrame:
    """Points of a regular grid inside or on each run's boundary (run_id, ring), with ids pt_%06d over the points kept, x by x.

    The step is metres / 111000 degrees on both axes; the last column and row lie below the maximum. Ids come from counts of the
    kept points in each column and a prefix sum of these.
    """
    step = metres / 111000.0
    box = boundary.withColumn("rx", F.transform("ring", lambda p: p["x"])).withColumn("ry", F.transform("ring", lambda p: p["y"]))
    lo_x, lo_y = F.array_min("rx"), F.array_min("ry")
    count = lambda hi, lo: F.greatest(F.ceil((hi - lo) / step), F.lit(0))
    columns = box.withColumn("nx", count(F.array_max("rx"), lo_x)).withColumn("ny", count(F.array_max("ry"), lo_y)).filter("nx > 0 and ny > 0")
    columns = columns.select(*keys, "ring", lo_x.alias("lo_x"), lo_y.alias("lo_y"), "ny", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("i"))
    # few bytes make many points: without a number of its own the shuffle would leave them to one task
    columns = columns.repartition(int(boundary.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "i")
    points = columns.select(*keys, "ring", "i", (F.col("lo_x") + F.col("i") * step).alias("longitude"), "lo_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)).alias("j"))
    points = points.withColumn("latitude", F.col("lo_y") + F.col("j") * step)
    kept = written(points.filter(inside_ring(F.col("longitude"), F.col("latitude"), "ring")).select(*keys, "i", "j", "longitude", "latitude"), "grid")
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(*keys, "i").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = Window.partitionBy(*keys, "i").orderBy("j")
    number = F.row_number().over(own) + F.col("before")
    return dealt(kept).join(dealt(counts), [*keys, "i"]).withColumn("point_id", F.format_string("pt_%06d", number)).select(*keys, "point_id", "longitude", "latitude", "i", "j")
