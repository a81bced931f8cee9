"""Nearest shapes where edges crowd, are long, coincide or lie far away, against brute force; opened lists grow with the points."""

import numpy as np
import pytest

from emberlattice.operators import pyramid
from emberlattice.operators import spatial as S

SHAPE = "layer string, feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>"


def brute(points, lines):
    a, b = np.array([v[0] for v in lines]), np.array([v[1] for v in lines])
    d = b - a
    out = {}
    for name, x, y in points:
        p = np.array([x, y])
        length = (d * d).sum(1)
        t = np.clip(((p - a) * d).sum(1) / np.where(length == 0, 1, length), 0, 1)
        out[name] = np.sqrt((((a + t[:, None] * d) - p) ** 2).sum(1).min())
    return out


def table(spark, lines, layer="roads"):
    rows = [(layer, i, "line", [[(float(x), float(y)) for x, y in line]]) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, SHAPE)


def ask(spark, xy):
    return [(f"p{i:05}", float(x), float(y)) for i, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("kind, size", [("crowd", 0.5), ("crowd", 1000.0), ("coincident", 0.5), ("long", 0.001), ("far", 0.5), ("one place", 0.001)])
def test_against_brute_force(spark, kind, size):
    rng = np.random.default_rng(len(kind))
    xy = rng.random((150, 2)) * 10 - 5
    a = rng.random((400, 2)) * 10 - 5
    lines = np.stack([a, a + rng.normal(size=(400, 2)) * 0.05], axis=1)
    if kind == "crowd":
        lines[:350] = lines[:350] * 1e-3 + 2
    elif kind == "coincident":
        lines[100:] = lines[0]
    elif kind == "long":
        lines[::5, 1] = -lines[::5, 0] * 3
    elif kind == "far":
        xy[:80] = xy[:80] * 1e4 + 1e5
    else:
        lines[:, :, :] = 1.25
    points = ask(spark, xy)
    got = {r.point_id: r.distance for r in S.nearest_distance(spark.createDataFrame(points, "point_id string, longitude double, latitude double"), table(spark, lines), size).collect()}
    want = brute(points, lines)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_large_polygon_with_a_hole_and_bad_rows(spark):
    def ring(r):
        return [(-r, -r), (r, -r), (r, r), (-r, r), (-r, -r)]

    nan, none = float("nan"), None
    shapes = spark.createDataFrame([("parks", 1, "polygon", [ring(100.0), ring(10.0)]), ("parks", 2, "point", [[(nan, 1.0)]]), ("water", 3, "point", [[(0.0, 0.0)]]), ("none", 4, "line", [])], SHAPE)
    points = [("in", 50.0, 50.0), ("hole", 9.0, 0.0), ("out", 103.0, 104.0), ("edge", 100.0, 3.0), ("bad", nan, 1.0), ("null", none, 1.0), ("in", 50.0, 50.0)]
    df = spark.createDataFrame(points, "point_id string, longitude double, latitude double")
    got = {(r.point_id, r.layer): r.distance for r in S.nearest_distance(df, shapes, 0.01).collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == "parks"} == {"in": 0.0, "hole": 1.0, "out": 5.0, "edge": 0.0}
    assert got["hole", "water"] == 9.0 and len(got) == 8
    assert S.nearest_distance(df.limit(0), shapes, 0.01).count() == 0


@pytest.mark.parametrize("where", ["within", "far"])
def test_opened_lists_grow_with_the_points_alone(spark, monkeypatch, where):
    """Four times the edges in one tile leave the lists that a point opens, and the edges in a list, as they are."""
    pairs = []
    real = pyramid.fronts

    def counting(*args):
        out = real(*args)
        pairs.append((out.count(), out.filter("not own").count()))
        return out

    monkeypatch.setattr(pyramid, "fronts", counting)
    for n in (1500, 6000):
        rng = np.random.default_rng(2)
        a = rng.random((n, 2))
        xy = rng.random((200, 2)) + (50 if where == "far" else 0)
        df = spark.createDataFrame(ask(spark, xy), "point_id string, longitude double, latitude double")
        S.nearest_distance(df, table(spark, np.stack([a, a + 0.001], axis=1)), 1.0).count()
    assert all(left == 0 for _, left in pairs)
    assert pairs[1][0] <= 2 * pairs[0][0] and pairs[1][0] <= 12 * 200, pairs


def test_lists_are_short(spark):
    from emberlattice.scratch import Scratch

    rng = np.random.default_rng(3)
    a = rng.random((4000, 2)) * 0.1
    edges = S.segments(table(spark, np.stack([a, a + 1e-4], axis=1)))
    held, lowest = pyramid.held_edges(edges, 1.0, 1, float(a.min()), float(a.min()), Scratch(spark, "test"))
    sizes = held.groupBy("e", "cx", "cy").count()
    assert lowest < -1 and held.count() == 4000 and sizes.agg({"count": "max"}).first()[0] <= pyramid.LEAF
