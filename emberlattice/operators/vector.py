"""Vector layers: clean-up flags, reprojection, clipping, centroid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.functions.projection import utm
from emberlattice.operators.spatial import inside_ring

PARTS = "array<array<struct<x:double,y:double>>>"


def not_empty(parts: str = "parts") -> Column:
    return F.coalesce(F.size(F.filter(parts, lambda p: F.size(p) > 0)) > 0, F.lit(False))


def validity(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Flags: has_geometry, finite (all coordinates are numbers), closed (rings end where they start, polygons only), enough (vertices), unrepeated (no ring goes along
    the same edge twice, in either direction; polygons only)."""
    polygon = F.col("geom_type") == "polygon"
    finite = F.forall(parts, lambda p: F.forall(p, lambda v: v["x"].isNotNull() & v["y"].isNotNull() & ~F.isnan(v["x"]) & ~F.isnan(v["y"])))
    closed = F.forall(parts, lambda p: (F.size(p) > 0) & (p[0]["x"] == F.element_at(p, -1)["x"]) & (p[0]["y"] == F.element_at(p, -1)["y"]))
    least = F.when(polygon, 4).when(F.col("geom_type") == "line", 2).otherwise(1)
    enough = F.forall(parts, lambda p: F.size(p) >= least)
    point = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))
    ends = lambda p: F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("b"))
    edge = lambda e: F.struct(F.least(point(e["a"]), point(e["b"])).alias("low"), F.greatest(point(e["a"]), point(e["b"])).alias("high"))
    # edges in order: equal ones stand side by side
    ordered = F.transform(parts, lambda p: F.sort_array(F.filter(F.transform(ends(p), edge), lambda e: e["low"] != e["high"])))
    twice = F.exists("ordered_edges", lambda s: F.exists(F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("a"), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("b")), lambda e: e["a"] == e["b"]))
    flagged = df.withColumns({"has_geometry": not_empty(parts), "finite": finite, "closed": closed | ~polygon, "enough": enough, "ordered_edges": ordered})
    return flagged.withColumn("unrepeated", ~twice | ~polygon).drop("ordered_edges")


def clean(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Rows with valid, non-empty shapes."""
    flags = ["has_geometry", "finite", "closed", "enough", "unrepeated"]
    kept = validity(df, parts)
    for f in flags:
        kept = kept.filter(F.coalesce(F.col(f), F.lit(False)))
    return kept.drop(*flags)


def reproject(df: DataFrame, to_srid: int, parts: str = "parts", srid: str = "srid") -> DataFrame:
    """WGS84 shapes to a UTM zone, vertex by vertex; shapes already there, and shapes without a system, stay as they are."""
    target = F.lit(to_srid)

    def moved(v):
        e, n = utm(v["x"], v["y"], target)
        return F.struct(e.alias("x"), n.alias("y"))

    out = F.transform(parts, lambda p: F.transform(p, moved))
    return df.withColumn(parts, F.when(F.col(srid) == 4326, out).otherwise(F.col(parts))).withColumn(srid, target)


def clip_points(points: DataFrame, boundary: DataFrame, x: str = "longitude", y: str = "latitude", keys=("run_id",)) -> DataFrame:
    """Points inside or on their run's boundary (keys, ring)."""
    return points.join(boundary.select(*keys, "ring"), list(keys)).filter(inside_ring(F.col(x), F.col(y), "ring")).drop("ring")


def clip_shapes(shapes: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Shapes cut to a convex boundary: polygons edge by edge, lines segment by segment (a line that leaves and comes back gives a part for
    each stay), points by where they lie; parts outside vanish, shapes without a part left too. A null list of parts passes."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    edge = [p for i, p in enumerate(ring) if i == 0 or p != ring[0]]
    edge = edge if area > 0 else edge[::-1]

    def cut(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        for a, b in zip(edge, edge[1:] + edge[:1], strict=True):
            side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in points]
            out = []
            for i, (p, s) in enumerate(zip(points, side, strict=True)):
                q, t = points[i - 1], side[i - 1]
                if (s >= 0) != (t >= 0):
                    w = t / (t - s)
                    out.append((q[0] + w * (p[0] - q[0]), q[1] + w * (p[1] - q[1])))
                if s >= 0:
                    out.append(p)
            points = out
        return points

    def closed(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
        new = cut(points[:-1])
        return [[*new, new[0]]] if len(set(new)) > 2 else []

    def stays(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
        sides = [[(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in points] for a, b in zip(edge, edge[1:] + edge[:1], strict=True)]
        out: list[list[tuple[float, float]]] = []
        for i, (p, q) in enumerate(zip(points, points[1:], strict=False)):
            first, last = 0.0, 1.0
            for side in sides:
                s, t = side[i], side[i + 1]
                if s < 0 and t < 0:
                    first = 2.0
                elif s < 0:
                    first = max(first, s / (s - t))
                elif t < 0:
                    last = min(last, s / (s - t))
            if first < last:
                start, end = ((p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1])) if 0 < w < 1 else (q if w else p) for w in (first, last))
                if first == 0 and out and out[-1][-1] == start:
                    out[-1].append(end)
                else:
                    out.append([start, end])
        return out

    def within(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
        edges = list(zip(edge, edge[1:] + edge[:1], strict=True))
        own = [(x, y) for x, y in points if all((b[0] - a[0]) * (y - a[1]) >= (b[1] - a[1]) * (x - a[0]) for a, b in edges)]
        return [own] if own else []

    rules = {"polygon": closed, "line": stays, "point": within}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for kind, parts in zip(frame["geom_type"], frame["parts"], strict=True):
                if kind not in rules or parts is None:
                    kept.append(parts)
                    continue
                new = [part for p in parts for part in rules[kind]([(v["x"], v["y"]) for v in p])]
                kept.append([[{"x": x, "y": y} for x, y in p] for p in new])
            frame = frame.assign(parts=kept)
            yield frame[[p is None or len(p) > 0 for p in kept]]

    return shapes.mapInPandas(run, shapes.schema)


def centroid(boundary: DataFrame, keys=("run_id",)) -> DataFrame:
    """Area centroid of each ring by shoelace sums."""
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    edge = boundary.select(*keys, F.explode(pairs).alias("e"))
    cross = F.col("e.a.x") * F.col("e.b.y") - F.col("e.b.x") * F.col("e.a.y")
    sums = edge.groupBy(*keys).agg(F.sum(cross).alias("s"), F.sum((F.col("e.a.x") + F.col("e.b.x")) * cross).alias("sx"), F.sum((F.col("e.a.y") + F.col("e.b.y")) * cross).alias("sy"))
    return sums.select(*keys, (F.col("sx") / (3 * F.col("s"))).alias("longitude"), (F.col("sy") / (3 * F.col("s"))).alias("latitude"))


def bounding_box(df: DataFrame, x: str = "longitude", y: str = "latitude", keys=()) -> DataFrame:
    """minx, miny, maxx, maxy; zeros for an empty table."""
    z = F.lit(0.0)
    return df.groupBy(*keys).agg(*(F.coalesce(f(c), z).alias(n) for n, f, c in (("minx", F.min, x), ("miny", F.min, y), ("maxx", F.max, x), ("maxy", F.max, y))))
