"""The three jobs: landed files to checked records, layers and rasters to features, features to the hotspot layer."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberlattice.functions import expressions as E
from emberlattice.functions import projection as P
from emberlattice.operators import contour as K
from emberlattice.operators import quality as Q
from emberlattice.operators import raster as R
from emberlattice.operators import spatial as S
from emberlattice.operators import thermal as T
from emberlattice.sources import catalogue as C
from emberlattice.sources import files as X
from emberlattice.scratch import cleaned, interim, written

LAYERS = ("water", "parks", "roads")


@dataclass(frozen=True)
class Grid:
    metres: float = 100.0
    tile_degrees: float = 0.002
    radius_m: float = 50.0
    divisor: float = 10.0


@dataclass(frozen=True)
class Hotspots:
    k: int = 8
    cell_m: float = 100.0
    connectivity: int = 8
    save_stages: bool = False
    stage_folder: str | None = None


def proximity(points: DataFrame, shapes: DataFrame, size: float, keys=("point_id",)) -> DataFrame:
    """Points with a distance in metres to each layer; 0 for a layer without shapes."""
    own = S.nearest_distance(points, shapes.filter(F.col("layer").isin(*LAYERS)), size)
    wide = own.groupBy("point_id").pivot("layer", list(LAYERS)).agg(F.first("distance"))
    out = points.join(wide, "point_id", "left")
    return out.withColumns({f"distance_to_{v}_m": F.coalesce(E.degrees_to_metres(F.col(v)), F.lit(0.0)) for v in LAYERS}).drop(*LAYERS)


def ingest(spark: SparkSession, folder: str, layers=("water", "parks", "roads", "buildings")) -> DataFrame:
    """Checks of landed layers and files: (name, status, issues), with an overall row. The boundary must be there; what else is missing or
    unreadable fails its own check only."""
    boundary = X.read_geojson(spark, f"{folder}/boundary.geojson")
    if boundary.isEmpty():
        raise ValueError("the boundary has no features")
    found = X.read_layers(spark, folder, layers).withColumn("srid", F.lit(4326)).withColumn("geometry", F.to_json(F.when(F.size("parts") > 0, F.col("parts"))))
    checks = Q.layer_check(found).select(F.col("layer").alias("name"), "status", "issues")
    named = spark.createDataFrame([(n,) for n in layers], "name string").join(checks, "name", "left")
    rows = named.select("name", F.coalesce("status", F.lit("FAILED")).alias("status"), F.coalesce("issues", F.lit("missing")).alias("issues"))
    files = X.valid_files(X.file_records(spark, f"{folder}/*.geojson")).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.when(F.col("valid"), "PASSED").otherwise("FAILED").alias("status"), F.lit("").alias("issues")
    )
    every = written(rows.unionByName(files), "checks")
    return every.unionByName(Q.overall(every).select(F.lit("overall").alias("name"), "status", F.concat(F.col("failed").cast("string"), F.lit(" failed")).alias("issues")))


@dataclass(frozen=True)
class Source:
    """A landed source of the ingest job: how to read it, and what its metadata record says. kind: vector, weather or raster."""

    name: str
    kind: str
    read: Callable[[SparkSession], DataFrame]
    provider: str = "N/A"
    license: str = "N/A"
    resolution: str = "N/A"
    fatal: bool = False


def landed_sources(folder: str, layers=("water", "parks", "roads", "buildings")) -> list[Source]:
    """What the ingest job takes from a folder: the boundary, without which it stops, vector layers, weather as JSON, and rasters as pixels with headers."""
    layer = lambda name, **more: Source(name, "vector", lambda spark: X.read_geojson(spark, f"{folder}/{name}.geojson"), "OpenStreetMap", "ODbL", **more)
    raster = lambda name, who, what: Source(name, "raster", lambda spark: spark.read.parquet(f"{folder}/{name}/pixels.parquet").join(spark.read.parquet(f"{folder}/{name}/headers.parquet"), "scene_id"), who, resolution=what)
    weather = Source("weather", "weather", lambda spark: C.weather_days(spark.read.text(f"{folder}/weather.json"), json_col="value"), "NASA POWER", resolution="daily")
    return [layer("boundary", fatal=True), *map(layer, layers), weather, raster("elevation", "Copernicus", "30 m"), raster("cover", "ESA", "10 m")]


def observed(kind: str) -> list:
    """The figures that a source's check needs, gathered while it is written."""
    rows = F.count(F.lit(1)).alias("rows")
    if kind == "vector":
        corner, own = F.flatten("parts"), lambda v: lambda p: p[v]
        ends = [f(g(F.transform(corner, own(v)))).alias(f"{n}_{v}") for v in ("x", "y") for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))]
        return [rows, F.count_if(F.size("parts") == 0).alias("empty"), *ends]
    if kind == "raster":
        right, bottom = F.col("left") + F.col("width") * F.col("res_x"), F.col("top") - F.col("height") * F.col("res_y")
        sane = (F.col("width") > 0) & (F.col("height") > 0) & F.col("left").isNotNull() & F.col("top").isNotNull()
        each = F.lit(1.0) / (F.col("width") * F.col("height") * F.col("bands"))  # a whole scene's pixels add up to 1
        return [rows, F.count_if(~sane).alias("empty"), F.sum(each).alias("scenes"), F.min("left").alias("lo_x"), F.max(right).alias("hi_x"), F.min(bottom).alias("lo_y"), F.max("top").alias("hi_y")]
    return [rows]


def checked(kind: str, found: dict) -> tuple[str, str]:
    """Status and issues of a source by what was observed."""
    if not found["rows"]:
        return ("WARNING" if kind == "weather" else "FAILED"), "empty"
    if kind == "raster" and (found["empty"] or abs(found["scenes"] - round(found["scenes"])) > 1e-6):
        return "FAILED", "incomplete"
    return ("WARNING", "null_geometries") if kind == "vector" and found["empty"] else ("PASSED", "")


def run_ingest(spark: SparkSession, sources: list[Source], out: str, city: str, now: str) -> dict:
    """Writes each source as a table below `out`, checks it, and keeps a metadata record of it; returns the run's summary.

    A source's figures are observed while it is written, so checks cost no second scan; only repeated shapes are looked for in what was written (geometries
    alone). A source that can't be read or is empty fails for itself and is listed under errors; a fatal one stops the run. The report is saved
    as JSON lines; records (13 fields each) are appended, and the latest of each dataset counts (latest_records).
    """
    errors, rows, records = [], [], []
    for s in sources:
        path, found, status, issues = f"{out}/{s.name}.parquet", {"rows": 0}, "FAILED", "missing"
        try:
            figures = Observation(s.name)
            s.read(spark).observe(figures, *observed(s.kind)).write.mode("overwrite").parquet(path)
            found = figures.get
            status, issues = checked(s.kind, found)
            if status == "PASSED" and s.kind == "vector":
                shape = F.sha2(F.to_json("parts"), 256)
                repeats = spark.read.parquet(path).groupBy(shape.alias("shape")).count().agg(F.sum(F.col("count") - 1)).first()[0]
                status, issues = ("WARNING", "duplicate_geometries") if repeats else (status, issues)
            if status == "FAILED":
                raise ValueError(f"the table is {issues}")
        except Exception as e:  # noqa: BLE001  whatever a source's reader raises, the others go on
            if s.fatal:
                raise RuntimeError(f"{s.name}: the run can't go on without it") from e
            errors.append(f"{s.name}: {str(e).splitlines()[0]}")
        box = [found.get(k) for k in ("lo_x", "lo_y", "hi_x", "hi_y")]
        record = {
            "dataset_name": s.name, "source": s.kind, "provider": s.provider, "download_time": now, "projection": "EPSG:4326" if s.kind != "weather" else "N/A",
            "bounding_box": "N/A" if None in box else ",".join(f"{v:.6f}" for v in box), "resolution": s.resolution, "license": s.license, "version": "1.0.0", "storage_path": path, "status": status,
        }
        records.append((s.name, now, record))
        rows.append((s.name, status, issues, int(found["rows"])))
    sized = {r["name"]: r for r in written_sizes(spark, out, [s.name for s in sources if not any(e.startswith(f"{s.name}:") for e in errors)])}
    for name, _, record in records:
        record |= {"file_size_bytes": str(sized[name]["bytes"]) if name in sized else "N/A", "checksum": sized[name]["checksum"] if name in sized else "N/A"}
    spark.createDataFrame(records, "dataset_name string, download_time string, record map<string,string>").write.mode("append").parquet(f"{out}/metadata.parquet")
    report = spark.createDataFrame(rows, "name string, status string, issues string, rows long")
    X.write_report(report, f"{out}/validation_report.json")
    done = "SUCCESS" if not errors else "COMPLETED_WITH_ERRORS"
    return {"city": city, "status": done, "validation": Q.overall(report).first().asDict(), "errors": errors, "tables": {n: f"{out}/{n}.parquet" for n, status, *_ in rows if status != "FAILED"}, "report": f"{out}/validation_report.json"}


def written_sizes(spark: SparkSession, out: str, names: list[str]) -> list:
    """Bytes of each written table, and a digest of its files' digests."""
    if not names:
        return []
    files = X.file_records(spark, [f"{out}/{n}.parquet/*.parquet" for n in names]).withColumn("name", F.regexp_extract("path", r"([^/]+)\.parquet/[^/]+$", 1))
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("checksum")), ""), 256)
    return files.groupBy("name").agg(F.sum("length").alias("bytes"), digest.alias("checksum")).collect()


def latest_records(spark: SparkSession, out: str) -> DataFrame:
    """(dataset_name, download_time, record): the last record of each dataset over all runs into `out`."""
    return C.latest(spark.read.parquet(f"{out}/metadata.parquet"))


def in_zones(shapes: DataFrame, points: DataFrame, margin_m: float) -> DataFrame:
    """(srid, feature_id, geom_type, parts): shapes in metres of each zone (srid) whose points' box, grown by the margin, theirs touches."""
    lon, lat = F.col("longitude"), F.col("latitude")
    zones = points.groupBy("srid").agg(F.min(lon).alias("a"), F.min(lat).alias("b"), F.max(lon).alias("c"), F.max(lat).alias("d")).collect()
    corner = F.flatten("parts")
    cx, cy = F.transform(corner, lambda p: p["x"]), F.transform(corner, lambda p: p["y"])
    boxed = shapes.select("feature_id", "geom_type", "parts", F.array_min(cx).alias("lo"), F.array_min(cy).alias("low"), F.array_max(cx).alias("hi"), F.array_max(cy).alias("high"))
    north = margin_m / 55000.0
    meets = []
    for z in zones:
        east = north / max(math.cos(math.radians(min(max(abs(z.b), abs(z.d)) + north, 89.0))), 0.01)
        hit = (F.col("hi") >= z.a - east) & (F.col("lo") <= z.c + east) & (F.col("high") >= z.b - north) & (F.col("low") <= z.d + north)
        meets.append(F.when(hit, F.lit(z.srid)))
    found = boxed.withColumn("srid", F.explode(F.array_compact(F.array(*meets).cast("array<int>"))))

    def moved(v):
        e, n = P.utm(v["x"], v["y"], F.col("srid"))
        return F.struct(e.alias("x"), n.alias("y"))

    return found.select("srid", "feature_id", "geom_type", F.transform("parts", lambda p: F.transform(p, moved)).alias("parts"))


def build_features(boundary: DataFrame, shapes: DataFrame, headers: DataFrame, bands: DataFrame, ground: DataFrame, cover: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """The 14 feature columns of every grid point (and run_id, longitude, latitude).

    boundary: (run_id, ring); shapes: (layer, feature_id, geom_type, parts) in degrees; headers and pixels by scene_id = run_id: bands (red, green, nir,
    swir, lst), ground (value: elevation), cover (value: code).
    """
    points = written(S.regular_grid(boundary, grid.metres).withColumn("scene_id", F.col("run_id")).withColumn("own_id", F.col("point_id")), "grid")
    points = points.withColumn("point_id", F.concat_ws("/", "run_id", "own_id"))
    points = T.per_run(points, [F.avg("longitude").alias("mid_lon"), F.avg("latitude").alias("mid_lat")])
    points = points.withColumn("srid", P.utm_srid(F.col("mid_lon"), F.col("mid_lat"))).drop("mid_lon", "mid_lat")
    near = proximity(points, shapes, grid.tile_degrees)
    x, y = P.utm(F.col("longitude"), F.col("latitude"), F.col("srid"))
    placed = near.withColumns({"utm_x_m": x, "utm_y_m": y})
    buildings = in_zones(shapes.filter("layer = 'buildings'"), points, grid.radius_m)
    dense = S.building_density(placed, buildings, grid.radius_m, grid.divisor, keys=("srid",))
    spectral = R.spectral_columns(R.sample(dense, headers, bands, values=("red", "green", "nir", "swir", "lst")))
    terrain = R.sample(spectral, headers, R.terrain(ground, headers), clamp=True, values=("elevation_m", "slope_deg", "aspect_deg"))
    full = R.sample(terrain, headers, cover, values=("value",)).withColumn("land_cover_code", E.land_cover(F.col("value")))
    return full.select(
        "run_id", F.col("own_id").alias("point_id"), "longitude", "latitude", *(f"distance_to_{v}_m" for v in LAYERS), "building_density", "ndvi", "ndbi", "ndwi", "lst_celsius",
        F.coalesce("elevation_m", F.lit(12.0)).alias("elevation_m"), F.coalesce("slope_deg", F.lit(0.0)).alias("slope_deg"), F.coalesce("aspect_deg", F.lit(0.0)).alias("aspect_deg"), "land_cover_code",
    )


def write_features(features: DataFrame, folder: str) -> None:
    """Parquet by run, GeoJSON lines, and a report of missing values."""
    own = written(features, "features")
    X.write_points(own, f"{folder}/features.parquet")
    X.write_geojson(own, f"{folder}/features.geojsonl")
    Q.null_counts(own, [c for c in own.columns if c != "run_id"]).write.mode("overwrite").json(f"{folder}/validation.json")


def save_stage(stage: DataFrame, name: str, settings: Hotspots) -> None:
    """A stage's output without geometry, if the settings ask for it."""
    if settings.save_stages:
        if not settings.stage_folder:
            raise ValueError("save_stages needs a stage_folder")
        stage.drop("geometry").write.mode("overwrite").parquet(f"{settings.stage_folder}/{name}.parquet")


def build_hotspots(features: DataFrame, settings: Hotspots = Hotspots()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Layer, registry and report of the features of any number of runs; raises at a gate that fails."""
    if "utm_x_m" not in features.columns:
        srid = P.utm_srid(F.col("mid_lon"), F.col("mid_lat"))
        placed = features.join(T.quantiles(features, {"mid_lon": F.col("longitude"), "mid_lat": F.col("latitude")}, 0.5), "run_id", "left")
        x, y = P.utm(F.col("longitude"), F.col("latitude"), srid)
        features = placed.withColumns({"utm_x_m": x, "utm_y_m": y}).drop("mid_lon", "mid_lat")
    aligned = written(T.align(features), "aligned")
    Q.require(Q.alignment_gate(aligned), "alignment")
    save_stage(aligned, "aligned", settings)
    points = written(T.nighttime(T.anomaly(T.delineate(aligned))), "points")
    Q.require(Q.mask_summary(points), "delineation")
    Q.require(Q.night_summary(points), "night")
    save_stage(points, "points", settings)
    hot = T.ranked_hotspots(points, settings.k)
    save_stage(hot.drop("city_temperature_percentile", "temperature_rank", "temperature_total_pixels"), "hotspots", settings)
    scored = T.labelled_scores(hot, settings.cell_m, settings.connectivity)
    layer = written(T.final_layer(scored.withColumn("geometry", X.wkb_point(F.col("longitude"), F.col("latitude")))), "layer")
    clusters = written(T.registry(layer, settings.cell_m), "registry")
    report = Q.layer_report(layer, clusters)
    Q.require(report, "final layer")
    return layer, clusters, report


def write_hotspots(layer: DataFrame, clusters: DataFrame, report: DataFrame, folder: str) -> None:
    X.write_folders(layer, f"{folder}/knowledge_layer.parquet")
    write_beside(layer, clusters, report, folder)


def write_beside(layer: DataFrame, clusters: DataFrame, report: DataFrame, folder: str) -> None:
    """What write_hotspots leaves beside the layer's Parquet. GeoJSON takes sixteen times the bytes of that, so its lines are packed."""
    X.write_geojson(layer, f"{folder}/knowledge_layer.geojsonl", packed=True)
    clusters.write.mode("overwrite").parquet(f"{folder}/hotspot_registry.parquet")
    report.write.mode("overwrite").json(f"{folder}/cluster_validation.json")
    Q.manifest(layer, clusters).write.mode("overwrite").json(f"{folder}/metadata.json")


def export_hotspots(spark: SparkSession, scored: Callable[[], DataFrame], folder: str, cell_m: float = 100.0) -> None:
    """write_hotspots of scored points, made when called, with less on disk: their layer stands in the folder alone, from where all else reads it, and the
    tables that lead to it go before the rest is written."""
    path = f"{folder}/knowledge_layer.parquet"
    with cleaned(spark):
        with interim(spark):
            layer = T.final_layer(scored().withColumn("geometry", X.wkb_point(F.col("longitude"), F.col("latitude"))))
            X.write_folders(layer, path)
        layer = spark.read.schema(layer.schema).parquet(path).select(layer.columns)
        clusters = written(T.registry(layer, cell_m), "registry")
        write_beside(layer, clusters, Q.layer_report(layer, clusters), folder)


def cluster_polygons(layer: DataFrame, folder: str, settings: Hotspots = Hotspots()) -> None:
    """Clusters as unions of their cells in EPSG:4326, holes included, a GeoJSON feature a line with the cluster's figures as properties."""
    figures, shapes = T.cluster_shapes(layer, settings.cell_m), K.to_degrees(T.cluster_polygons(layer, settings.cell_m))
    own = figures.join(shapes, ["run_id", "hotspot_id"])
    pairs = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))
    out = own.select("run_id", "hotspot_id", "area_m2", "perimeter_m", "size_pixels", F.bround("mean_lst", 2).alias("mean_lst"), F.bround("peak_lst", 2).alias("peak_lst"), geometry.alias("shape"))
    X.write_geojson(out, f"{folder}/clusters.geojsonl", F.col("shape"), leave=("shape",))
