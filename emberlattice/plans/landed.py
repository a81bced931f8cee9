"""Queries over landed files: each writes a table into the shared folder with one of the sinks and reads it back with a source."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emberlattice.functions import projection as P
from emberlattice.operators import quality as Q
from emberlattice.operators import thermal as T
from emberlattice.plans import adapters as A
from emberlattice.plans import jobs
from emberlattice.plans import queries as heat
from emberlattice.plans.queries import CLUSTERED, DUPLICATES, NIGHTLY, REGISTRY, SCORED, SQL, query, text_layer, w
from emberlattice.scratch import shared_folder
from emberlattice.sources import catalogue as C
from emberlattice.sources import files as X

c = F.col


def landing(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("snk_1_points_parquet", w(A.CELLS, "SELECT run_id, point_id, round(longitude, 6) AS x, round(latitude, 6) AS y FROM cells"))
def _(spark, d):
    path = landing(spark, "points")
    X.write_points(A.cells(spark, d).select("run_id", "point_id", "longitude", "latitude"), path)
    x, y = X.wkb_point_xy(c("geometry"))
    return spark.read.parquet(path).select("run_id", "point_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("snk_2_points_geojson", w(A.CELLS, "SELECT point_id, 'point' AS geom_type, land_cover_code::VARCHAR AS cover, round(longitude, 6) AS x, round(latitude, 6) AS y FROM cells"))
def _(spark, d):
    path = landing(spark, "features")
    X.write_geojson(A.cells(spark, d).select("point_id", "longitude", "latitude", "land_cover_code"), path)
    at = c("parts")[0][0]
    return X.read_geojson_lines(spark, path).select(
        c("tags")["point_id"].alias("point_id"), "geom_type", c("tags")["land_cover_code"].alias("cover"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y")
    )


@query("src_1_boundary", w(A.SHAPES, "SELECT feature_id::VARCHAR AS k, round(x, 6) AS lo_x, round(y, 6) AS lo_y, round(x + w, 6) AS hi_x, round(y + h, 6) AS hi_y FROM shapes WHERE layer = 'parks'"))
def _(spark, d):
    """Parks as boundaries: feature collections of polygons."""
    path = f"{landing(spark, 'boundary')}/boundary.geojson"
    X.write_collections(A.shapes(spark, d).filter("layer = 'parks'"), path, X.polygon(c("parts")[0]))
    ring = c("parts")[0]
    corners = {"lo_x": ring[0]["x"], "lo_y": ring[0]["y"], "hi_x": ring[2]["x"], "hi_y": ring[2]["y"]}
    return X.read_geojson(spark, path).select(c("tags")["feature_id"].alias("k"), *(F.round(v, 6).alias(n) for n, v in corners.items()))


@query("src_3_first_candidate", w(A.CELLS, "SELECT point_id, land_cover_code AS cover, round(longitude, 6) AS x, round(latitude, 6) AS y FROM cells"))
def _(spark, d):
    """The first candidate isn't there; the second one has a geometry and no coordinates."""
    folder = landing(spark, "candidates")
    own = A.cells(spark, d).withColumn("geometry", X.wkb_point(c("longitude"), c("latitude")))
    own.select("point_id", "land_cover_code", "geometry").write.parquet(f"{folder}/features.parquet")
    found = X.read_first(spark, [f"{folder}/missing.parquet", f"{folder}/features.parquet"])
    return found.select("point_id", c("land_cover_code").alias("cover"), F.round("longitude", 6).alias("x"), F.round("latitude", 6).alias("y"))


@query("src_2_vector_layers", w(A.SHAPES, """SELECT layer, feature_id::VARCHAR AS k, CASE WHEN layer = 'roads' THEN 'line' ELSE 'polygon' END AS geom_type,
    CASE WHEN layer = 'roads' THEN 2 ELSE 5 END AS corners, round(x, 6) AS x, round(y, 6) AS y FROM shapes"""))
def _(spark, d):
    """Feature collections of three layers; the fourth is absent."""
    folder, shapes = landing(spark, "layers"), A.shapes(spark, d)
    line = F.struct(F.lit("LineString").alias("type"), F.transform(c("parts")[0], lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    for layer in jobs.LAYERS:
        X.write_collections(shapes.filter(c("layer") == layer), f"{folder}/{layer}.geojson", line if layer == "roads" else X.polygon(c("parts")[0]))
    ring = c("parts")[0]
    return X.read_layers(spark, folder).select(
        "layer", c("tags")["feature_id"].alias("k"), "geom_type", F.size(ring).alias("corners"), F.round(ring[0]["x"], 6).alias("x"), F.round(ring[0]["y"], 6).alias("y")
    )


@query("src_4_stage_inputs", w(A.CELLS, """, tried AS (SELECT * FROM (VALUES (0, 'own'), (1, 'output'), (2, 'output'), (3, 'between'), (4, 'between'), (5, 'between'), (6, 'between'), (7, 'processed'), (8, 'processed')) v(j, place))
SELECT j AS removed, place, count(*) AS points, round(min(longitude), 6) AS x, round(max(latitude), 6) AS y FROM cells JOIN tried ON gx % 9 = j GROUP BY j, place"""))
def _(spark, d):
    """The last stage reads the first of its candidates: with all of them there, and with one after the other gone until the last is left."""
    own, out = A.cells(spark, d).withColumn("geometry", X.wkb_point(c("longitude"), c("latitude"))), None
    folders = {place: landing(spark, place) for place in ("output", "between", "processed", "own")}
    paths = X.stage_candidates("export", *(folders[p] for p in ("output", "between", "processed")), own=f"{folders['own']}/input.parquet")
    for j in reversed(range(len(paths))):  # the last one lands first, and each one before it takes its place
        place = next(name for name, folder in folders.items() if paths[j].startswith(folder))
        own.filter(c("gx") % len(paths) == j).select("point_id", "geometry", F.lit(place).alias("place")).write.parquet(paths[j])
        one = X.read_first(spark, paths).withColumn("removed", F.lit(j))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("removed", "place").agg(F.count("*").alias("points"), F.round(F.min("longitude"), 6).alias("x"), F.round(F.max("latitude"), 6).alias("y"))


@query("job_1_ingest", w(A.SHAPES + ", " + A.PIXELS, """, checks AS (
    SELECT layer AS name, CASE WHEN count(*) > count(DISTINCT (x, y, w, h)) THEN 'WARNING' ELSE 'PASSED' END AS status, count(*) AS "rows" FROM shapes GROUP BY layer
    UNION ALL SELECT 'boundary', 'PASSED', 1 UNION ALL SELECT 'buildings', 'FAILED', 0 UNION ALL SELECT 'cover', 'FAILED', 0
    UNION ALL SELECT 'weather', 'PASSED', count(*) FROM (SELECT DISTINCT strftime(ts, '%Y%m%d') FROM events WHERE user_id = (SELECT min(user_id) FROM events))
    UNION ALL SELECT 'elevation', CASE WHEN count(*) = any_value(width * height) THEN 'PASSED' ELSE 'FAILED' END, count(*) FROM pixels, header
) SELECT name, status, "rows", status AS recorded, 13::BIGINT AS fields FROM checks
UNION ALL SELECT 'run', CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'SUCCESS' END, count(*) FILTER (status = 'FAILED'), NULL, NULL FROM checks"""))
def _(spark, d):
    """The ingest job over landed files: a layer and a raster are missing. Its report, its records, and the run's status with the number of errors."""
    folder, out, shapes = landing(spark, "ingest"), landing(spark, "ingested"), A.shapes(spark, d)
    X.write_collections(A.boundary(spark, d).filter("run_id = 'r0'").withColumn("feature_id", F.lit(0)), f"{folder}/boundary.geojson", X.polygon(c("ring")))
    line = F.struct(F.lit("LineString").alias("type"), F.transform(c("parts")[0], lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    for layer in jobs.LAYERS:
        X.write_collections(shapes.filter(c("layer") == layer), f"{folder}/{layer}.geojson", line if layer == "roads" else X.polygon(c("parts")[0]))
    users = A.weather_documents(spark, d)
    users.join(A.table(spark, d, "events").agg(F.min("user_id").alias("user_id")), "user_id").select("json").write.text(f"{folder}/weather.json")
    A.pixels(spark, d).write.parquet(f"{folder}/elevation/pixels.parquet")
    A.headers(spark, d).write.parquet(f"{folder}/elevation/headers.parquet")
    summary = jobs.run_ingest(spark, jobs.landed_sources(folder), out, "r0", "2024-05-15T00:00:00")
    report = spark.read.schema("name string, status string, rows long").json(summary["report"])
    records = jobs.latest_records(spark, out).select(c("dataset_name").alias("name"), c("record")["status"].alias("recorded"), F.size("record").cast("long").alias("fields"))
    own = report.join(records, "name", "left").select("name", "status", "rows", "recorded", "fields")
    run = spark.createDataFrame([("run", summary["status"], len(summary["errors"]), None, None)], own.schema)
    return own.unionByName(run)


@query("src_7_snk_8_weather_csv", f"SELECT * EXCLUDE (user_id) FROM ({SQL['src_5_weather_days']})")
def _(spark, d):
    path = landing(spark, "weather")
    X.write_weather_csv(C.weather_days(A.weather_documents(spark, d), keys=("user_id",)), path)
    return X.read_weather_csv(spark, path)


def exported(spark: SparkSession, d: str) -> str:
    """The folder of the hotspot job's outputs."""
    folder = landing(spark, "hotspots")
    jobs.export_hotspots(spark, lambda: T.all_stages(A.cells(spark, d)), folder)
    return folder


@query("snk_3_layer_parquet", w(SCORED, "SELECT point_id, hotspot_id, confidence_class, round(longitude, 6) AS x, round(latitude, 6) AS y FROM scored"))
def _(spark, d):
    x, y = X.wkb_point_xy(c("geometry"))
    own = spark.read.parquet(f"{exported(spark, d)}/knowledge_layer.parquet")
    return own.select("point_id", "hotspot_id", "confidence_class", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("snk_4_registry_parquet", w(SCORED, REGISTRY))
def _(spark, d):
    return spark.read.parquet(f"{exported(spark, d)}/hotspot_registry.parquet").drop("run_id", "cluster_bbox")


@query("snk_5_metadata_json", f"SELECT run_id, total_sample_points, urban_area_km2, total_hotspot_clusters FROM ({SQL['agg_15_manifest']})")
def _(spark, d):
    schema = "run_id string, total_sample_points long, urban_area_km2 double, total_hotspot_clusters long"
    return spark.read.schema(schema).json(f"{exported(spark, d)}/metadata.json")


@query("snk_6_stage_outputs", w(NIGHTLY, "SELECT point_id, is_urban, round(suhii_day_celsius, 4) AS suhii_day, thermal_retention_class FROM nightly"))
def _(spark, d):
    settings = jobs.Hotspots(save_stages=True, stage_folder=landing(spark, "stages"))
    jobs.save_stage(heat.nightly(spark, d).withColumn("geometry", X.wkb_point(c("longitude"), c("latitude"))), "points", settings)
    own = spark.read.parquet(f"{settings.stage_folder}/points.parquet")
    assert "geometry" not in own.columns
    return own.select("point_id", "is_urban", F.round("suhii_day_celsius", 4).alias("suhii_day"), "thermal_retention_class")


@query("snk_7_cluster_polygons", w(CLUSTERED, """, beside AS MATERIALIZED (
    SELECT a.id AS x, b.id AS y FROM scan a JOIN scan b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1 AND b.gx BETWEEN a.gx - 1 AND a.gx + 1
), reach4 AS (SELECT id, id AS root FROM scan UNION SELECT beside.y, reach4.root FROM reach4 JOIN beside ON beside.x = reach4.id),
pieces AS (SELECT id, min(root) AS piece FROM reach4 GROUP BY id),
cell AS (SELECT hotspot_id, gx, gy, piece FROM scan JOIN pieces USING (id) JOIN labels USING (point_id)), rim AS (
    SELECT c.hotspot_id, count(*) AS n_sides FROM (SELECT hotspot_id, gx + dx AS gx, gy + dy AS gy FROM cell, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)) c
    ANTI JOIN cell USING (hotspot_id, gx, gy) GROUP BY 1
), met AS (
    SELECT hotspot_id, count(*) AS n, count(*) = 2 AND count(DISTINCT a) = 2 AND count(DISTINCT b) = 2 AS crossed, min(piece) = max(piece) AS same
    FROM (SELECT hotspot_id, gx + a AS i, gy + b AS j, a, b, piece FROM cell, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)) GROUP BY hotspot_id, i, j
), turns AS (
    SELECT hotspot_id, count(*) FILTER (n IN (1, 3)) + 2 * count(*) FILTER (crossed) AS n_corners,
        (count(*) FILTER (n = 1) - count(*) FILTER (n = 3) + 2 * count(*) FILTER (crossed AND NOT same) - 2 * count(*) FILTER (crossed AND same)) // 4 AS less FROM met GROUP BY hotspot_id
) SELECT hotspot_id, count(*) AS n_cells, any_value(n_sides)::BIGINT AS n_sides, any_value(n_corners)::BIGINT AS n_corners,
    count(DISTINCT piece) AS n_shells, (count(DISTINCT piece) - any_value(less))::BIGINT AS n_holes
FROM cell JOIN rim USING (hotspot_id) JOIN turns USING (hotspot_id) GROUP BY hotspot_id"""))
def _(spark, d):
    """Clusters' outlines in degrees, read back and measured in metres: their area in cells, their rings' length in sides, corners, shells and holes."""
    folder = landing(spark, "clusters")
    jobs.cluster_polygons(heat.clustered(spark, d), folder)
    back = X.read_geojson_lines(spark, f"{folder}/clusters.geojsonl").select(c("tags")["hotspot_id"].alias("hotspot_id"), F.explode("parts").alias("ring"))

    def metres(p):
        x, y = P.utm(p["x"], p["y"], F.lit(32644))
        return F.struct(x.alias("x"), y.alias("y"))

    sides = F.arrays_zip(F.slice("m", 1, F.size("m") - 1).alias("a"), F.slice("m", 2, F.size("m") - 1).alias("b"))
    total = lambda f: F.aggregate("sides", F.lit(0.0), lambda s, e: s + f(e["a"], e["b"]))
    origin = lambda p, k: p[k] - c("m")[0][k]  # noqa: E731  near the ring, for precision
    area = total(lambda a, b: (origin(a, "x") * origin(b, "y") - origin(b, "x") * origin(a, "y")) / 2)
    length = total(lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    own = back.withColumn("m", F.transform("ring", metres)).withColumn("sides", sides).select("hotspot_id", area.alias("area"), length.alias("length"), (F.size("ring") - 1).alias("corners"))
    return own.groupBy("hotspot_id").agg(
        F.round(F.sum("area") / 10000.0).cast("long").alias("n_cells"), F.round(F.sum("length") / 100.0).cast("long").alias("n_sides"),
        F.sum("corners").alias("n_corners"), F.count_if(c("area") > 0).alias("n_shells"), F.count_if(c("area") < 0).alias("n_holes"),
    )


@query("snk_10_validation_report", f"SELECT layer, features, nulls, repeats, CASE WHEN nulls + repeats > 0 THEN 'WARNING' ELSE 'PASSED' END AS status FROM ({DUPLICATES})")
def _(spark, d):
    path = landing(spark, "report")
    X.write_report(Q.layer_check(text_layer(spark, d)), path)
    return spark.read.schema("layer string, features long, nulls long, repeats long, status string").json(path)


#: Shapes lie 1.42 degrees further north, on the raster, and the grid's points take the place of the customers' spots.
FEATURES = (
    heat.GRADIENT
    + """, box AS (SELECT 80.13003::DOUBLE AS x0, 14.48004::DOUBLE AS y0, x0 + (0.01::DOUBLE + count(*) * 0.00001::DOUBLE) AS x1, y0 + 0.0199::DOUBLE AS y1 FROM customer), ids AS (
    SELECT *, unnest(range(0, ceil((x1 - x0) / (100.0::DOUBLE / 111000.0::DOUBLE))::BIGINT)) AS i, ceil((y1 - y0) / (100.0::DOUBLE / 111000.0::DOUBLE))::BIGINT AS ny FROM box
), places AS (
    SELECT 'pt_' || lpad((row_number() OVER (ORDER BY i, j))::VARCHAR, 6, '0') AS point_id, x0 + i * (100.0::DOUBLE / 111000.0::DOUBLE) AS longitude, y0 + j * (100.0::DOUBLE / 111000.0::DOUBLE) AS latitude,
        floor((14.5::DOUBLE - latitude) / 0.0009::DOUBLE)::INTEGER AS r, floor((longitude - 80.1::DOUBLE) / 0.0009::DOUBLE)::INTEGER AS c FROM (SELECT *, unnest(range(0, ny)) AS j FROM ids)
), """
    + A.SHAPES.replace("* 53 % 1000)::DOUBLE * 0.0001::DOUBLE AS y", "* 53 % 1000)::DOUBLE * 0.0001::DOUBLE + 1.42::DOUBLE AS y").replace(
        A.SHAPES[A.SHAPES.index("spots AS (") : A.SHAPES.index("along AS (")], "spots AS (SELECT point_id, longitude AS px, latitude AS py FROM places), "
    )
    + """, apart AS (SELECT point_id, layer, distance * 111000.0::DOUBLE AS m FROM distances), bands AS (
    SELECT r, c, value, value * 0.001::DOUBLE AS red, value * 0.002::DOUBLE + 0.05::DOUBLE AS green, value * 0.003::DOUBLE AS nir, 0.3::DOUBLE - value * 0.0005::DOUBLE AS swir, value / 8 AS lst,
        ([10, 50, 80, 30, 60])[(r * 7 + c) % 5 + 1] AS code FROM pixels
)"""
)


@query("job_2_features", w(FEATURES, """SELECT point_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
    round((SELECT max(m) FROM apart a WHERE a.point_id = p.point_id AND layer = 'water'), 2) AS distance_to_water_m, round((SELECT max(m) FROM apart a WHERE a.point_id = p.point_id AND layer = 'parks'), 2) AS distance_to_parks_m,
    round((SELECT max(m) FROM apart a WHERE a.point_id = p.point_id AND layer = 'roads'), 2) AS distance_to_roads_m, 0.0::DOUBLE AS building_density,
    round(coalesce(CASE WHEN value IS NOT NULL THEN least(greatest((nir - red) / (nir + red), -1), 1) END, 0.35), 4) AS ndvi, round(coalesce(CASE WHEN value IS NOT NULL THEN least(greatest((swir - nir) / (swir + nir), -1), 1) END, 0.15), 4) AS ndbi, round(coalesce(CASE WHEN value IS NOT NULL THEN least(greatest((green - nir) / (green + nir), -1), 1) END, -0.10), 4) AS ndwi,
    round(CASE WHEN lst IS NULL OR lst < 10 THEN 33.5 ELSE least(greatest(lst, 15), 55) END, 8) AS lst_celsius, round(coalesce(elevation_m, 12), 6) AS elevation_m, round(coalesce(slope_deg, 0), 4) AS slope_deg,
    round(coalesce(aspect_deg, 0), 4) AS aspect_deg, coalesce(code, 50) AS land_cover_code
FROM places p LEFT JOIN bands b ON b.r = p.r AND b.c = p.c, header h LEFT JOIN terrain t ON t.r = least(greatest(p.r, 0), h.height - 1) AND t.c = least(greatest(p.c, 0), 99)"""))
def _(spark, d):
    """The feature job over one run: its table is written and read back."""
    x, y = F.lit(80.13003), F.lit(14.48004)
    far, top = x + (0.01 + c("n") * 0.00001), y + 0.0199
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    room = A.table(spark, d, "customer").agg(F.count("*").alias("n")).select(F.lit("s0").alias("run_id"), F.array(v(x, y), v(far, y), v(far, top), v(x, top), v(x, y)).alias("ring"))
    shapes = A.shapes(spark, d).withColumn("parts", F.transform("parts", lambda p: F.transform(p, lambda q: v(q["x"], q["y"] + 1.42))))
    pixels, heads = A.pixels(spark, d), A.headers(spark, d)
    value = F.nullif(c("value"), F.lit(-9999.0))
    spectral = {"red": value * 0.001, "green": value * 0.002 + 0.05, "nir": value * 0.003, "swir": 0.3 - value * 0.0005, "lst": value / 8}
    bands = pixels.select("scene_id", "row", "col", *(e.alias(n) for n, e in spectral.items()))
    codes = F.element_at(F.array(*map(F.lit, (10, 50, 80, 30, 60))), (c("row") * 7 + c("col")) % 5 + 1)
    folder = landing(spark, "features")
    jobs.write_features(jobs.build_features(room, shapes, heads, bands, pixels, pixels.withColumn("value", codes.cast("double"))), folder)
    own = spark.read.parquet(f"{folder}/features.parquet")
    near = {n: F.round(n, 2).alias(n) for n in ("distance_to_water_m", "distance_to_parks_m", "distance_to_roads_m")}
    place = {n: F.round(n, 6).alias(n) for n in ("longitude", "latitude")}
    digits = {"lst_celsius": 8, "elevation_m": 6}  # prices have so many after the point: no ties
    rest = {n: F.round(n, digits.get(n, 4)).alias(n) for n in ("ndvi", "ndbi", "ndwi", "lst_celsius", "elevation_m", "slope_deg", "aspect_deg")}
    return own.select("point_id", *place.values(), *near.values(), "building_density", *rest.values(), "land_cover_code")
