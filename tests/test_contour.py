"""Outlines of cells against the cells themselves: areas, holes, corners met once, and the way back from metres to degrees."""

import random
from collections import deque

from pyspark.sql import functions as F

from emberlattice.functions import projection as P
from emberlattice.operators import thermal as T
from emberlattice.operators.contour import polygons, rings
from emberlattice.plans import jobs
from emberlattice.sources import files as X


def pieces(cells):
    left, out = set(cells), []
    while left:
        seen = {left.pop()}
        todo = deque(seen)
        while todo:
            i, j = todo.popleft()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in left:
                    left.remove(n)
                    seen.add(n)
                    todo.append(n)
        out.append(seen)
    return out


def gaps(piece):
    """The 4-connected gaps that a piece encloses."""
    lo_i, hi_i = min(i for i, _ in piece) - 1, max(i for i, _ in piece) + 1
    lo_j, hi_j = min(j for _, j in piece) - 1, max(j for _, j in piece) + 1
    empty = pieces({(i, j) for i in range(lo_i, hi_i + 1) for j in range(lo_j, hi_j + 1)} - piece)
    return [g for g in empty if (lo_i, lo_j) not in g]


def twice_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def inside(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


def spiral(n):
    out, i, j, di, dj = set(), 0, 0, 1, 0
    for step in range(n, 0, -2):
        for _ in range(2):
            for _ in range(step):
                out.add((i, j))
                i, j = i + di, j + dj
            di, dj = -dj, di
    return out


def shapes():
    rng = random.Random(11)
    out = {
        "one": {(0, 0)},
        "diagonal": {(0, 0), (1, 1), (2, 0)},
        "ring": {(i, j) for i in range(3) for j in range(3)} - {(1, 1)},
        "open ring": {(i, j) for i in range(3) for j in range(3)} - {(1, 1), (2, 2)},
        "touching holes": {(i, j) for i in range(4) for j in range(4)} - {(1, 1), (2, 2)},
        "island": {(i, j) for i in range(7) for j in range(7)} - {(i, j) for i in range(1, 6) for j in range(1, 6)} | {(3, 3)},
        "spiral": spiral(24),
        "comb": {(i, j) for i in range(30) for j in range(6) if j == 0 or i % 2 == 0},
    }
    for k, share in enumerate((0.3, 0.5, 0.6, 0.75)):
        out[f"random {k}"] = {(i - 6, j - 9) for i in range(16) for j in range(16) if rng.random() < share}
    return out


def test_rings_bound_their_cells(spark):
    every = shapes()
    rows = [(name, "x", i, j) for name, cells in every.items() for i, j in cells]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "x", 1, 1), ("one", "x", None, 3)], "name string, corners string, i int, j int").repartition(3)
    got = {}
    for r in polygons(df, ["name"]).collect():
        got[r["name"]] = [[[(c.i, c.j) for c in ring] for ring in polygon] for polygon in r.polygons]
    assert set(got) == set(every)
    for name, cells in every.items():
        parts = pieces(cells)
        assert len(got[name]) == len(parts), name
        assert sorted(len(p) - 1 for p in got[name]) == sorted(len(gaps(p)) for p in parts), name
        for polygon in got[name]:
            assert [twice_area(r) > 0 for r in polygon] == [True] + [False] * (len(polygon) - 1), name
            for ring in polygon:
                assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1, name
                assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:]))
                assert all((a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, ring[1:], ring[2:])), "corners lie at turns only"
        assert sum(twice_area(r) for p in got[name] for r in p) == 2 * len(cells), name
        filled = {(i, j) for i in range(-12, 40) for j in range(-12, 40) if sum(inside(r, i + 0.5, j + 0.5) for p in got[name] for r in p) % 2}
        assert filled == cells, name
    length = {r["name"]: r["n"] for r in rings(df, ["name"]).groupBy("name").agg(F.sum("length").alias("n")).collect()}
    for name, cells in every.items():
        assert length[name] == sum((i + a, j + b) not in cells for i, j in cells for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert rings(df.limit(0), ["name"]).count() == 0


def test_metres_to_degrees_and_back(spark):
    rows = [(lon, lat) for lat in (-79.5, -33.2, -0.001, 0.0, 13.09, 51.4, 83.9) for zone in (1, 17, 44, 60) for lon in (zone * 6 - 183 + d for d in (-2.999, -1.2, 0.0, 2.7))]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("srid", P.utm_srid(F.col("lon"), F.col("lat")))
    x, y = P.utm(F.col("lon"), F.col("lat"), F.col("srid"))
    lon, lat = P.utm_inverse(F.col("x"), F.col("y"), F.col("srid"))
    placed = df.withColumns({"x": x, "y": y}).withColumns({"back_lon": lon, "back_lat": lat})
    again_x, again_y = P.utm(F.col("back_lon"), F.col("back_lat"), F.col("srid"))
    for r in placed.withColumns({"again_x": again_x, "again_y": again_y}).collect():
        assert abs(r.again_x - r.x) < 1e-3 and abs(r.again_y - r.y) < 1e-3, r
        assert abs(r.back_lat - r.lat) < 1e-8


def test_clusters_are_written_with_their_holes(spark, tmp_path):
    cells = {(i, j) for i in range(5) for j in range(4)} - {(2, 1)}
    rows = [("r", f"p{i}-{j}", "HOT_0001", 80.1 + i * 0.0009, 13.0 + j * 0.0009, 400000.0 + 100 * i, 1440000.0 + 100 * j) for i, j in cells]
    rows.append(("r", "far", None, 80.2, 13.1, 409000.0, 1449000.0))
    df = spark.createDataFrame(rows, "run_id string, point_id string, hotspot_id string, longitude double, latitude double, utm_x_m double, utm_y_m double")
    df = df.withColumns({c: F.lit(v) for c, v in (("lst_day_celsius", 40.256), ("suhii_day_celsius", 3.0), ("heat_persistence_index", 0.6))})
    metres = T.cluster_polygons(df).first()
    shell, hole = metres.polygons[0]
    assert len(metres.polygons) == 1 and metres.srid == 32644
    assert {(p.x, p.y) for p in shell} == {(x, y) for x in (399950.0, 400450.0) for y in (1439950.0, 1440350.0)}
    assert {(p.x, p.y) for p in hole} == {(x, y) for x in (400150.0, 400250.0) for y in (1440050.0, 1440150.0)}
    jobs.cluster_polygons(df, str(tmp_path))
    back = X.read_geojson_lines(spark, f"{tmp_path}/clusters.geojsonl").first()
    assert back.geom_type == "polygon" and len(back.parts) == 2 and set(back.tags) == {"run_id", "hotspot_id", "area_m2", "perimeter_m", "size_pixels", "mean_lst", "peak_lst"}
    assert float(back.tags["area_m2"]) == 190000.0 and back.tags["mean_lst"] == "40.26"
    assert all(79 < p.x < 81 and 12.9 < p.y < 13.2 for part in back.parts for p in part)


def test_repeated_edges(spark):
    from emberlattice.operators import vector as V

    v = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [
        (1, "polygon", [v((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))], True),
        (2, "polygon", [v((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))], True),  # a bow-tie crosses itself but repeats no edge
        (3, "polygon", [v((0, 0), (2, 2), (2, 0), (2, 2), (0, 2), (0, 0))], False),  # one that goes back
        (4, "polygon", [v((0, 0), (2, 0), (2, 2), (0, 0)), v((0, 0), (2, 0), (2, 2), (0, 0))], True),  # in two parts
        (5, "line", [v((0, 0), (1, 0), (0, 0))], True),
        (6, "polygon", [v((0, 0), (2, 0), (2, 0), (2, 2), (0, 2), (0, 0))], True),
    ]
    df = spark.createDataFrame(rows, "feature_id int, geom_type string, parts array<array<struct<x:double,y:double>>>, want boolean")
    assert all(r.unrepeated == r.want for r in V.validity(df).collect())
    assert {r.feature_id for r in V.clean(df).collect()} == {1, 2, 4, 5, 6}


def test_a_point_in_two_clusters(spark):
    from emberlattice.operators import quality as Q
    from emberlattice.plans import queries

    layer = T.written(T.final_layer(queries.scored(spark, "/root/testdata/sf0.001").withColumn("geometry", F.lit(b"x"))), "layer")
    twice = layer.filter("hotspot_id is not null").limit(1).withColumn("hotspot_id", F.lit("HOT_9999"))
    for df, want in ((layer, True), (layer.unionByName(twice), False)):
        checks = Q.layer_report(df, T.registry(layer)).first().checks
        assert len(checks) == 20 and checks["single_hotspot_membership_per_point"] is want
