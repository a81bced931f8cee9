"""Exact numbers of small tables, edge cases, and files written and read again."""

import json
import math

import pytest
from pyspark.sql import functions as F

from emberlattice.functions import expressions as E
from emberlattice.functions import projection as P
from emberlattice.operators import quality as Q
from emberlattice.operators import raster as R
from emberlattice.operators import spatial as S
from emberlattice.operators import thermal as T
from emberlattice.operators import vector as V
from emberlattice.operators.neighbours import k_nearest
from emberlattice.operators.graph import connected, lattice_components
from emberlattice.plans import jobs
from emberlattice.sources import catalogue as C
from emberlattice.sources import files as X


def one(df):
    return df.collect()[0]


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


RING = "array<struct<x:double,y:double>>"


def test_expressions(spark):
    z = spark.createDataFrame([(float(v),) for v in (-9, -3, -0.5, 0, 0.7, 1.96, 4, 8, 40)] + [(None,)], "z double")
    for r in z.select("z", E.upper_tail(F.col("z")).alias("p")).collect():
        assert abs(r.p - (1.0 if r.z is None else 0.5 * math.erfc(r.z / math.sqrt(2)))) < 1e-14
    row = one(spark.range(1).select(E.ndvi(F.lit(0.1), F.lit(0.5)).alias("a"), E.ndvi(F.lit(0.0), F.lit(0.0)).alias("b"), E.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("c"), E.persistence_ratio(F.lit(0.0), F.lit(2.0)).alias("d"), E.composite(F.lit(1.0), F.lit(None).cast("double")).alias("e"), E.tier(F.lit(95.0)).alias("f")))
    assert abs(row.a - 2 / 3) < 1e-12 and row.b is None and row.c == 0.5 and row.d == 2.0 and row.e is None and row.f == "Critical"
    x, y = one(spark.range(1).select(*P.utm(F.lit(80.142094), F.lit(13.096763), F.lit(32644))))
    assert 400_000 < x < 410_000 and 1_447_000 < y < 1_449_000


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(41), 100]) and got[200] == got[201] == 200 and 300 not in got
    cells = [("r", c, r) for c, r in ((0, 0), (1, 1), (2, 2), (5, 0), (5, 1), (6, 1), (0, 9))] + [("q", 0, 0), ("r", 1, 1)]
    df = spark.createDataFrame(cells, "run_id string, cx int, cy int")
    eight = {(r.run_id, r.cx, r.cy): r.number for r in lattice_components(df, 8).collect()}
    assert eight == {("r", 0, 0): 1, ("r", 1, 1): 1, ("r", 2, 2): 1, ("r", 5, 0): 2, ("r", 5, 1): 2, ("r", 6, 1): 2, ("r", 0, 9): 3, ("q", 0, 0): 1}
    four = {(r.run_id, r.cx, r.cy): r.number for r in lattice_components(df, 4).collect()}
    assert four["r", 0, 0] == 1 and four["r", 5, 1] == 2 and len({four["r", 0, 0], four["r", 1, 1], four["r", 2, 2]}) == 3
    snake = [("s", c, 0) for c in range(30)] + [("s", 29, 1)] + [("s", c, 2) for c in range(30)]
    assert {r.number for r in lattice_components(spark.createDataFrame(snake, "run_id string, cx int, cy int"), 4).collect()} == {1}
    assert lattice_components(df.limit(0)).count() == 0


def test_hotspots_on_a_block(spark):
    rows = []
    for i in range(10):
        for j in range(10):
            v, n = (8.0, 6.0) if 3 <= i <= 6 and 3 <= j <= 6 else (7.5, 5.5) if (i, j) == (0, 0) else (0.5, 0.2)
            rows.append(("r", f"p{i}{j}", 100.0 * j, 100.0 * i, v, n))
    df = spark.createDataFrame(rows, "run_id string, point_id string, utm_x_m double, utm_y_m double, suhii_day_celsius double, suhii_night_celsius double")
    out = {r.point_id: r for r in T.hotspots(df, k=4).collect()}
    assert sum(r.is_validated_hotspot for r in out.values()) >= 10 and not out["p00"].is_validated_hotspot and out["p45"].is_validated_hotspot
    flat = df.withColumn("suhii_day_celsius", F.lit(1.0)).withColumn("suhii_night_celsius", F.lit(None).cast("double"))
    assert {(r.gi_zscore_day, r.gi_zscore_night) for r in T.hotspots(flat, k=4).collect()} == {(0.0, 0.0)}


def test_neighbours_against_brute_force(spark):
    pts = [(f"p{i:03}", float((i * 37) % 101) ** 1.5, float((i * 53) % 97)) for i in range(150)] + [("twin", 0.0, 0.0), ("twin2", 0.0, 0.0), ("far", 90000.0, -5.0)]
    df = spark.createDataFrame([("r", *p) for p in pts] + [("lone", "x", 1.0, 1.0), ("r", "none", None, 1.0)], "run_id string, point_id string, utm_x_m double, utm_y_m double")
    got = {}
    for r in k_nearest(df, 6).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.near))
    for name, x, y in pts:
        want = sorted(pts, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[:6]
        assert [n for _, n in sorted(got[name])] == [p[0] for p in want]
    assert got["x"] == [(1, "x")] and "none" not in got


def test_nearest_and_counts(spark):
    shapes = spark.createDataFrame(
        [(1, "water", "polygon", [box(0, 0, 2, 2)]), (2, "roads", "line", [[{"x": 5.0, "y": 0.0}, {"x": 5.0, "y": 9.0}]]), (3, "parks", "point", [[{"x": 1.0, "y": 1.0}]]), (4, "roads", "line", [])],
        f"feature_id long, layer string, geom_type string, parts array<{RING}>",
    )
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 4.0, 1.0), ("c", 500.0, 400.0), ("d", None, 1.0)], "point_id string, longitude double, latitude double")
    got = {(r.point_id, r.layer): r.distance for r in S.nearest_distance(points, shapes, 0.5).collect()}
    assert got["a", "water"] == 0 and got["b", "water"] == 2 and got["a", "roads"] == 4 and got["b", "parks"] == 3
    assert abs(got["c", "roads"] - math.hypot(495, 391)) < 1e-9 and ("d", "water") not in got
    assert S.nearest_distance(points, shapes.limit(0), 0.5).count() == 0
    near = jobs.proximity(points, shapes.filter("layer = 'water'"), 0.5)
    assert {r.point_id: r.distance_to_roads_m for r in near.collect()} == dict.fromkeys("abcd", 0.0)
    boxes = spark.createDataFrame([(i, 10.0 * i, 0.0, 10.0 * i + 1, 1.0) for i in range(20)] + [(0, 0.0, 0.0, 1.0, 1.0)], "feature_id long, lo_x double, lo_y double, hi_x double, hi_y double")
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 51.0), ("z", 9e5, 0.0)], "point_id string, utm_x_m double, utm_y_m double")
    assert {r.point_id: r.building_density for r in S.building_density(pts, boxes).collect()} == {"a": 0.6, "b": 0.1, "z": 0.0}



def test_holes_are_outside(spark):
    """A lake with an island and a second part: on the island the shore is near, on the island's edge it is at 0."""
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    parts = [[{"x": x * 1.0, "y": y * 1.0} for x, y in r] for r in (box(0, 10), box(4, 7), box(20, 22))]
    shapes = spark.createDataFrame([("water", 1, "polygon", parts)], "layer string, feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([("island", 5.5, 5.0), ("lake", 2.0, 2.0), ("edge", 4.0, 5.0), ("part", 21.0, 21.0), ("land", 13.0, 5.0)], "point_id string, longitude double, latitude double")
    for size in (1.0, 6.0, 40.0):
        got = {r.point_id: r.distance for r in S.nearest_distance(points, shapes, size).collect()}
        assert got == {"island": 1.0, "lake": 0.0, "edge": 0.0, "part": 0.0, "land": 3.0}


def test_clusters_ranks_scores(spark):
    rows = [("r", i, x, y, hot, 40.0, 5.0, 0.7) for i, (x, y, hot) in enumerate(((0.0, 0.0, True), (100.0, 0.0, True), (5000.0, 5000.0, True), (9000.0, 0.0, False)))]
    df = spark.createDataFrame(rows, "run_id string, point_id int, utm_x_m double, utm_y_m double, is_validated_hotspot boolean, lst_day_celsius double, suhii_day_celsius double, heat_persistence_index double")
    ids = {r.point_id: r.hotspot_id for r in T.label_clusters(df).collect()}
    assert ids == {0: "HOT_0002", 1: "HOT_0002", 2: "HOT_0001", 3: None}
    temps = spark.createDataFrame([("r", i, 30 + 0.1 * i, i < 10, i >= 10) for i in range(100)], "run_id string, point_id int, lst_day_celsius double, is_water boolean, is_urban boolean")
    out = T.percentiles(temps).collect()
    land = [r for r in out if not r.is_water]
    assert len(land) == 90 and min(r.city_temperature_percentile for r in land) == 0 and max(r.city_temperature_percentile for r in land) == 100
    assert all(r.temperature_rank is None for r in out if r.is_water) and {r.temperature_total_pixels for r in out} == {90}
    assert one(T.percentiles(temps.filter("point_id = 50"))).city_temperature_percentile == 100.0
    pts = [("r", 1, 3.0, 2.0, 5.0, 4.0, 0.8, 90.0, "HOT_0001"), ("r", 2, 1.0, 2.5, 3.0, 3.0, 0.7, 60.0, "HOT_0001"), ("r", 3, 0.0, 0.0, 0.0, 0.0, 0.5, None, None)]
    sc = spark.createDataFrame(pts, "run_id string, point_id int, gi_zscore_day double, gi_zscore_night double, suhii_day_celsius double, suhii_night_celsius double, heat_persistence_index double, city_temperature_percentile double, hotspot_id string")
    got = {r.point_id: (r.hotspot_confidence_score, r.confidence_class) for r in T.score(sc).collect()}
    assert got[1] == (99.0, "Critical") and 0 <= got[2][0] <= 100 and got[3] == (None, None)


def test_masks_and_baseline(spark):
    rows = [("r", i, 50 if i < 100 else 10 if i < 190 else 80, 40.0 if i < 100 else 32.0, 28.0 if i < 100 else 22.0) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id string, point_id int, land_cover_code int, lst_day_celsius double, lst_night_celsius double")
    full = T.delineate(df.withColumns({"ndvi": F.lit(0.1), "ndbi": F.lit(None).cast("double"), "ndwi": F.lit(-0.2), "building_density": F.lit(0.0)}))
    s = one(Q.mask_summary(full))
    assert (s.n_urban, s.n_rural, s.n_water, s.valid) == (100, 90, 10, True)
    a = one(Q.anomaly_summary(T.anomaly(full)))
    assert (a.urban_mean_day, a.urban_mean_night, a.status) == (8.0, 6.0, "PASSED")
    none = T.baseline(full.withColumn("is_rural", F.lit(False)))
    assert one(none).baseline_day == 36.0
    with pytest.raises(ValueError):
        Q.require(Q.mask_summary(full.filter("is_water")), "delineation")


def test_grid_and_rasters(spark):
    b = spark.createDataFrame([("r", box(80.20, 13.00, 80.25, 13.05))], f"run_id string, ring {RING}")
    grid = S.regular_grid(b, 1000.0)
    rows = grid.orderBy("point_id").collect()
    assert len(rows) == 36 and rows[0].point_id == "pt_000001" and [r.point_id for r in rows] == [r.point_id for r in sorted(rows, key=lambda r: (r.i, r.j))]
    head = spark.createDataFrame([("r", 80.2, 13.05, 0.01, 0.01, 5, 5, 1, -1.0)], "scene_id string, left double, top double, res_x double, res_y double, width int, height int, bands int, nodata double")
    for kind, n in (("bands", 100), ("temperature", 25), ("elevation", 25), ("cover", 25)):
        px = R.synthetic(head, kind)
        assert px.count() == n and px.filter("value is null").count() == 0
    assert sorted(r.value for r in R.synthetic(head, "temperature").collect()) == sorted(r.value for r in R.synthetic(head, "temperature").repartition(3).collect())
    flat = R.terrain(R.synthetic(head, "elevation").withColumn("value", F.lit(-1.0)), head)
    assert {(r.elevation_m, r.slope_deg) for r in flat.collect()} == {(12.0, 0.0)}
    assert V.clip_points(grid, b).count() == 36


def test_vector_clean_clip_project(spark):
    rows = [
        (1, "polygon", [box(0, 0, 2, 2)], 4326), (2, "polygon", [box(3, 3, 4, 4)], 4326), (3, "polygon", [box(0, 0, 2, 2)[:3]], 4326), (4, "line", [[{"x": 0.0, "y": 0.0}]], 4326),
        (5, "point", [[{"x": float("nan"), "y": 0.0}]], 4326), (6, "point", None, 4326), (7, "point", [[{"x": 81.0, "y": 0.0}]], 4326), (8, "point", [[{"x": 5.0, "y": 6.0}]], None),
    ]
    df = spark.createDataFrame(rows, f"feature_id long, geom_type string, parts array<{RING}>, srid int")
    assert sorted(r.feature_id for r in V.clean(df).collect()) == [1, 2, 7, 8]
    cut = {r.feature_id: r.parts for r in V.clip_shapes(df.filter("feature_id < 3"), [(1, 1), (1, 9), (9, 9), (9, 1)]).collect()}
    assert {(p.x, p.y) for p in cut[1][0]} == {(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)} and {(p.x, p.y) for p in cut[2][0]} == {(3.0, 3.0), (4.0, 3.0), (4.0, 4.0), (3.0, 4.0)}
    moved = {r.feature_id: r.parts for r in V.reproject(df.filter("feature_id in (7, 8)"), 32644).collect()}
    assert abs(moved[7][0][0].x - 500000) < 1e-6 and abs(moved[7][0][0].y) < 1e-6 and moved[8][0][0].x == 5.0


def test_quantiles_equal_sorting(spark):
    rows = [("a" if i % 3 else None, float(i * 37 % 50) if i % 7 else None, float(i % 2)) for i in range(120)] + [("b", 4.5, None), ("c", None, None)]
    df = spark.createDataFrame(rows, "run_id string, v double, u double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.run_id: (r.x, r.y) for r in T.quantiles(df, {"x": F.col("v"), "y": F.col("u")}, share).collect()}
        want = {r.run_id: (r.x, r.y) for r in df.groupBy("run_id").agg(F.percentile("v", share).alias("x"), F.percentile("u", share).alias("y")).collect()}
        assert want.pop("c") == (None, None) and got.keys() == want.keys()
        for k, pair in want.items():
            assert [v and round(v, 9) for v in got[k]] == [v and round(v, 9) for v in pair], (k, share)
    assert T.quantiles(df.limit(0), {"x": F.col("v")}, 0.5).count() == 0


def test_clip_lines_and_points(spark):
    rows = [
        (1, "line", [[(0.0, 2.0), (2.0, 2.0), (4.0, 2.0), (4.0, 12.0), (6.0, 12.0), (6.0, 3.0)]]),  # enters, leaves, comes back
        (2, "line", [[(0.0, 0.0), (10.0, 0.5)]]),
        (3, "line", [[(9.0, 9.0), (12.0, 12.0)]]),  # touches a corner only
        (4, "point", [[(5.0, 5.0)]]), (5, "point", [[(0.0, 5.0), (1.0, 1.0)]]), (6, "point", [[(0.0, 0.0)]]),
        (7, "polygon", [[(9.0, 1.0), (12.0, 1.0), (12.0, 3.0), (9.0, 3.0), (9.0, 1.0)]]),  # beside the boundary, sharing an edge
        (8, "line", None), (9, "line", [[(3.0, 3.0)]]), (10, "line", []),
    ]
    df = spark.createDataFrame(rows, f"feature_id long, geom_type string, parts array<{RING}>")
    clipped = V.clip_shapes(df, [(1, 1), (9, 1), (9, 9), (1, 9)])
    cut = {r.feature_id: r.parts and [[(p.x, p.y) for p in part] for part in r.parts] for r in clipped.collect()}
    assert cut == {1: [[(1.0, 2.0), (2.0, 2.0), (4.0, 2.0), (4.0, 9.0)], [(6.0, 9.0), (6.0, 3.0)]], 4: [[(5.0, 5.0)]], 5: [[(1.0, 1.0)]], 8: None}


def geojson(kind, coordinates):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": {"a": "1"}}


def test_files_round_trip(spark, tmp_path):
    square = [[[80.2, 13.0], [80.25, 13.0], [80.25, 13.05], [80.2, 13.05], [80.2, 13.0]]]
    for name, items in {"boundary": [geojson("Polygon", square)], "water": [geojson("Polygon", square), geojson("Polygon", square)], "roads": [geojson("LineString", [[1, 2], [3, 4]]), geojson("MultiPolygon", [square])]}.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": items}))
    layers = X.read_layers(spark, str(tmp_path))
    assert sorted((r.layer, r.geom_type, len(r.parts)) for r in layers.collect()) == [("roads", "line", 1), ("roads", "polygon", 1), ("water", "polygon", 1), ("water", "polygon", 1)]
    report = {r.name: r.status for r in jobs.ingest(spark, str(tmp_path)).collect()}
    assert report["water"] == "WARNING" and report["roads"] == "PASSED" and report["parks"] == "FAILED" and report["overall"] == "PASSED_WITH_WARNINGS" and report["water.geojson"] == "PASSED"
    with pytest.raises(Exception):
        jobs.ingest(spark, str(tmp_path / "nowhere"))
    pts = spark.createDataFrame([("r", "a", 80.27, 13.08), ("r", "b", -0.1, 0.0), ("s", "c", -122.5, 37.25)], "run_id string, point_id string, longitude double, latitude double")
    X.write_points(pts, str(tmp_path / "p.parquet"))
    back = X.read_first(spark, [str(tmp_path / "none.parquet"), str(tmp_path / "p.parquet")])
    assert {(r.point_id, r.longitude, r.latitude) for r in back.collect()} == {("a", 80.27, 13.08), ("b", -0.1, 0.0), ("c", -122.5, 37.25)}
    only = spark.read.parquet(str(tmp_path / "p.parquet")).select("point_id", "geometry")
    x, y = X.wkb_point_xy(F.col("geometry"))
    assert {(r.point_id, r.x, r.y) for r in only.select("point_id", x.alias("x"), y.alias("y")).collect()} == {("a", 80.27, 13.08), ("b", -0.1, 0.0), ("c", -122.5, 37.25)}
    import struct

    assert {bytes(r.geometry) for r in only.collect()} == {b"\0" + struct.pack(">Idd", 1, *v) for v in ((80.27, 13.08), (-0.1, 0.0), (-122.5, 37.25))}
    X.write_geojson(pts, str(tmp_path / "p.geojson"))
    assert X.read_first(spark, [str(tmp_path / "p.geojson")]).filter("longitude = 80.27 and latitude = 13.08").count() == 1
    with pytest.raises(FileNotFoundError):
        X.read_first(spark, [str(tmp_path / "no.parquet")])
    days = C.weather_fallback(spark.createDataFrame([("2024-01-01", "2024-01-31")], "start string, end string"))
    days.write.csv(str(tmp_path / "w"), header=True)
    assert X.read_weather_csv(spark, str(tmp_path / "w")).count() == 31 and one(Q.weather_check(days)).status == "PASSED"


def test_feature_and_hotspot_jobs(spark, tmp_path):
    ring = box(80.20, 13.00, 80.212, 13.012)
    b = spark.createDataFrame([("r", ring), ("q", box(80.30, 13.00, 80.312, 13.012))], f"run_id string, ring {RING}")
    shapes = spark.createDataFrame(
        [(1, "water", "polygon", [box(80.201, 13.001, 80.203, 13.003)]), (2, "buildings", "polygon", [box(80.205, 13.005, 80.2051, 13.0051)]), (3, "roads", "line", [[{"x": 80.2, "y": 13.0}, {"x": 80.21, "y": 13.01}]])],
        f"feature_id long, layer string, geom_type string, parts array<{RING}>",
    )
    heads = spark.createDataFrame([(r, x, 13.013, 0.001, 0.001, 14, 14, 1, -9999.0) for r, x in (("r", 80.199), ("q", 80.299))], "scene_id string, left double, top double, res_x double, res_y double, width int, height int, bands int, nodata double")
    one_band = R.synthetic(heads, "bands")
    wide = one_band.groupBy("scene_id", "row", "col").pivot("band", [1, 2, 3, 4]).agg(F.first("value")).toDF("scene_id", "row", "col", "red", "green", "nir", "swir")
    wide = wide.join(R.synthetic(heads, "temperature").select("scene_id", "row", "col", F.col("value").alias("lst")), ["scene_id", "row", "col"])
    feats = jobs.build_features(b, shapes, heads, wide, R.synthetic(heads, "elevation"), R.synthetic(heads, "cover"))
    rows = feats.collect()
    assert len(rows) == 2 * 14 * 14 and all(v is not None for r in rows for v in r) and len(feats.columns) == 16
    assert any(r.building_density > 0 for r in rows) and min(r.distance_to_water_m for r in rows) == 0
    jobs.write_features(feats, str(tmp_path / "f"))
    read = spark.read.parquet(str(tmp_path / "f/features.parquet"))
    layer, clusters, report = jobs.build_hotspots(read.drop("geometry"))
    assert layer.count() == len(rows) and all(r.valid and len(r.checks) == 20 for r in report.collect())
    assert [c for c in layer.columns if c != "run_id"] == T.LAYER_COLUMNS
    jobs.write_hotspots(layer, clusters, report, str(tmp_path / "h"))
    jobs.cluster_polygons(layer, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h/metadata.json")).count() == 2


def ring_of(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in [*corners, corners[0]]]


def test_building_density_takes_real_shapes(spark):
    shapes = spark.createDataFrame(
        [
            (1, "polygon", [ring_of((0, 0), (400, 400), (390, 410), (-10, 10))]),  # slanted
            (2, "polygon", [box(1000, 0, 1010, 10), box(1400, 0, 1410, 10)]),  # two parts
            (3, "polygon", [box(2000, 0, 2400, 400), box(2100, 100, 2300, 300)]),  # courtyard
            (4, "polygon", [ring_of((3000, 0), (3400, 0), (3400, 20), (3020, 20), (3020, 400), (3000, 400))]),  # L
            (5, "point", [[{"x": 4000.0, "y": 0.0}, {"x": 4400.0, "y": 0.0}]]), (6, "polygon", []),
            (3, "polygon", [box(2000, 0, 2400, 400), box(2100, 100, 2300, 300)]),  # the same row again
        ],
        f"feature_id long, geom_type string, parts array<{RING}>",
    )
    at = {
        "slanted far": (300, 50, 0), "slanted near": (220, 180, 1), "between parts": (1200, 5, 0), "second part": (1450, 5, 1), "courtyard": (2200, 200, 0),
        "courtyard wall": (2150, 200, 1), "inside": (2050, 50, 1), "deep inside": (2350, 200, 1), "L far": (3200, 200, 0), "L near": (3070, 200, 1), "between points": (4200, 0, 0), "edge": (4450, 0, 1),
    }
    points = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y, _) in at.items()], "point_id string, utm_x_m double, utm_y_m double")
    assert {r.point_id: r.building_density * 10 for r in S.building_density(points, shapes).collect()} == {n: v for n, (_, _, v) in at.items()}
    wide = spark.createDataFrame([(7, "polygon", [box(-500, -500, 500, 500)])], shapes.schema)
    assert one(S.touching_count(points.limit(0).union(spark.createDataFrame([("m", 0.0, 0.0)], points.schema)), wide, 50.0)).n == 1


def test_features_count_real_buildings(spark):
    """Points of two runs, one across a border of zones; buildings slanted, in two parts and beyond the border."""
    runs = spark.createDataFrame([("r", box(80.20, 13.00, 80.212, 13.012)), ("z", box(83.995, 13.00, 84.004, 13.003))], f"run_id string, ring {RING}")
    far = box(80.201, 13.001, 80.2011, 13.0011), box(80.210, 13.010, 80.2101, 13.0101)
    shapes = spark.createDataFrame(
        [(1, "buildings", "polygon", [*far]), (2, "buildings", "polygon", [ring_of((80.2, 13.0), (80.212, 13.012), (80.2119, 13.0121))]), (3, "buildings", "polygon", [box(84.0001, 13.0, 84.0031, 13.003)]),
         (4, "buildings", "polygon", [box(74.205, 13.005, 74.206, 13.006)])],
        f"feature_id long, layer string, geom_type string, parts array<{RING}>",
    )
    heads = spark.createDataFrame([(r, x, 13.013, 0.001, 0.001, 14, 14, 1, -9999.0) for r, x in (("r", 80.199), ("z", 83.994))], "scene_id string, left double, top double, res_x double, res_y double, width int, height int, bands int, nodata double")
    wide = R.synthetic(heads, "bands").groupBy("scene_id", "row", "col").pivot("band", [1, 2, 3, 4]).agg(F.first("value")).toDF("scene_id", "row", "col", "red", "green", "nir", "swir").withColumn("lst", F.lit(20.0))
    rows = jobs.build_features(runs, shapes, heads, wide, R.synthetic(heads, "elevation"), R.synthetic(heads, "cover")).collect()
    metres = lambda p, lat=13.0: (p[0] * 111320 * math.cos(math.radians(lat)), p[1] * 110650)

    def distance(p, shape):
        (x, y), best = metres(p), math.inf
        for ring in shape:
            odd = False
            for a, b in zip(ring, ring[1:]):
                (ax, ay), (bx, by) = metres((a["x"], a["y"])), metres((b["x"], b["y"]))
                dx, dy = bx - ax, by - ay
                t = min(max(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1)
                best = min(best, math.hypot(ax + t * dx - x, ay + t * dy - y))
                odd ^= (ay > y) != (by > y) and x < ax + (y - ay) * dx / (by - ay)
            best = 0 if odd else best
        return best

    parts = [r.parts for r in shapes.collect()]
    checked = 0
    for r in rows:
        far_from = [distance((r.longitude, r.latitude), p) for p in parts]
        if all(abs(d - 50) > 2 for d in far_from):
            checked += 1
            assert round(r.building_density * 10) == sum(d < 50 for d in far_from), (r, far_from)
    assert checked > 150 and {round(r.building_density * 10) for r in rows if r.run_id == "z"} == {0, 1}


def test_catalogue(spark):
    files = spark.createDataFrame([("s", "b", 200_000), ("s", "a", 200_000), ("s", "c", 5), ("t", "d", 9)], "sensor string, path string, length long")
    assert [(r.sensor, r.path) for r in C.largest_file(files).collect()] == [("s", "a")]
    rec = spark.createDataFrame([("x", {"dataset_name": "x"})], "dataset_name string, record map<string,string>")
    assert one(Q.metadata_check(rec)).status == "WARNING"
    full = rec.withColumn("record", C.complete(F.col("record"), Q.METADATA_KEYS))
    assert one(Q.metadata_check(full)).status == "PASSED" and one(full).record["license"] == "N/A" and one(full).record["dataset_name"] == "x"
