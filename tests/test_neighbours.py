"""Nearest neighbours where points crowd, coincide or lie far apart, against brute force; pairs grow with the points."""

import random

import numpy as np
import pytest

from emberlattice.operators import neighbours as module
from emberlattice.operators.neighbours import k_nearest, nearest_sums


def brute(points, k):
    ids = np.array([p[1] for p in points])
    xy = np.array([p[2:4] for p in points])
    order_of_id = np.argsort(np.argsort(ids))
    out = {}
    for n, (run, name, x, y) in enumerate(points):
        d2 = (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2
        out[name] = list(ids[np.lexsort((order_of_id, d2))[:k]])
    return out


def got(spark, points, k):
    df = spark.createDataFrame(points, "run_id string, point_id string, utm_x_m double, utm_y_m double").repartition(4)
    out = {}
    for r in k_nearest(df, k).collect():
        out.setdefault(r.point_id, {})[r["rank"]] = r.near
    return {name: [ranks[i] for i in range(1, len(ranks) + 1)] for name, ranks in out.items()}


@pytest.mark.parametrize("kind", ["crowd", "coincident", "line", "few"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "crowd":  # most in a small part of the run's width, some around, some far away
        xy = np.concatenate([500 + rng.random((900, 2)) * 0.05, 500 + rng.normal(size=(150, 2)) * 3, rng.random((150, 2)) * 1000])
    elif kind == "coincident":
        xy = np.concatenate([np.full((900, 2), 7.0), np.full((40, 2), 7.5), rng.integers(0, 30, (500, 2)).astype(float)])
    elif kind == "line":
        xy = np.stack([np.sort(rng.random(700)) ** 4 * 1e5, np.full(700, -3.0)], axis=1)
    else:
        xy = rng.random((4, 2))
    points = [("r", f"p{i:05}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    assert got(spark, points, 9) == brute(points, 9)


def test_runs_stand_apart(spark):
    rng = np.random.default_rng(5)
    own = [[(run, f"{run}{i:03}", *map(float, rng.random(2) * size)) for i in range(n)] for run, n, size in (("a", 300, 1.0), ("b", 40, 1e7), ("c", 1, 1.0))]
    bad = [("a", "nan", float("nan"), 1.0), ("a", "none", None, 1.0), ("b", "inf", float("inf"), 1.0), (None, "lost", 1.0, 1.0)]
    want = {name: near for points in own for name, near in brute(points, 5).items()}
    assert got(spark, [p for points in own for p in points] + bad, 5) == want
    assert got(spark, [], 5) == {}


def met_rows(spark, points, monkeypatch):
    counted = []

    class Counting(module.Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            if name.startswith("front"):
                counted.append(out.count())
            return out

    monkeypatch.setattr(module, "Scratch", Counting)
    df = spark.createDataFrame(points, "run_id string, point_id string, utm_x_m double, utm_y_m double")
    assert k_nearest(df, 9).count() == 9 * len(points)
    monkeypatch.undo()
    return sum(counted)


@pytest.mark.parametrize("kind", ["one tile", "equal"])
def test_opened_cells_grow_with_the_points(spark, monkeypatch, kind):
    sizes = []
    for n in (2000, 8000):
        rng = np.random.default_rng(2)
        xy = rng.random((n, 2)) if kind == "one tile" else np.full((n, 2), 3.0)
        points = [("r", f"p{i:05}", float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("r", "far", 1e3, 1e3)]
        sizes.append(met_rows(spark, points, monkeypatch))
    assert sizes[1] <= 6 * sizes[0] + 100 and sizes[1] <= 16 * 8000, sizes


def test_sums_of_neighbours(spark):
    """Sums come without the neighbours themselves: even, crowded, equal and far places, and what is missing, are as k_nearest has them."""
    rng = random.Random(3)
    points = [(f"g{i:03}", i % 20 * 100.0, i // 20 * 100.0) for i in range(200)] + [(f"c{i:03}", 5000 + rng.random(), rng.random()) for i in range(90)]
    points += [(f"t{i:02}", 700.0, 5000.0) for i in range(30)] + [("far", -90000.0, 7.0), ("out", float("nan"), 1.0)]
    rows = [("r", *p, None if i % 3 == 0 else rng.random(), None if p[0] < "f" else i) for i, p in enumerate(points)] + [("s", "one", 1.0, 1.0, None, 4)]
    df = spark.createDataFrame(rows, "run_id string, point_id string, utm_x_m double, utm_y_m double, a double, b int")
    want = {}
    for r in sorted(k_nearest(df, 6, values=("a", "b")).collect(), key=lambda r: r["rank"]):
        have = want.setdefault((r.run_id, r.point_id), [None, None])
        for i, v in enumerate((r.a, r.b)):
            have[i] = have[i] if v is None else v + (have[i] or 0.0)
    sums = nearest_sums(df, 6, ("a", "b"))
    got = {(r.run_id, r.point_id): [r.a, r.b] for r in sums.collect()}
    assert got == want and len(got) == len(rows) - 1 and any(v[1] is None for v in want.values())
    assert sums.count() == len(got) and nearest_sums(df.limit(0), 6, ("a",)).count() == 0
