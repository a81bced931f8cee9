"""Readers and writers of landed files: GeoJSON, Parquet with WKB points, CSV, JSON; file metadata records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlattice.sources.collections import feature_texts

FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
POINT = "array<double>"
RING = "array<array<double>>"


def xy(rings: Column) -> Column:
    """Coordinate pairs to structs."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, geom_type, parts, tags) of feature collections; geometries stay arrays of points. feature_id counts a file's features from 0.

    A file is read by as many tasks as it has stretches. A feature that can't be parsed has no parts and no tags. Raises if the file is not there or isn't whole.
    """
    found = feature_texts(spark, path).select(F.col("n").alias("feature_id"), F.from_json("text", FEATURE).alias("f"))
    return features(found.filter("f.type is null or f.type = 'Feature'"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature a line, as write_geojson leaves them: read in parallel."""
    lines = spark.read.text(path).select(F.from_json("value", FEATURE).alias("f"))
    return features(lines.withColumn("feature_id", F.monotonically_increasing_id()))


def features(df: DataFrame) -> DataFrame:
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.array(F.array(F.from_json(text, POINT)))
    line = F.array(F.from_json(text, RING))
    many = F.from_json(text, f"array<{RING}>")
    parts = F.when(kind == "Point", point).when(kind.isin("LineString", "MultiPoint"), line).when(kind.isin("Polygon", "MultiLineString"), many).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{RING}>>")))
    family = F.when(kind.like("%Polygon"), "polygon").when(kind.like("%LineString"), "line").when(kind.like("%Point"), "point")
    return df.select(F.col("feature_id").cast("long").alias("feature_id"), family.alias("geom_type"), F.coalesce(xy(parts), F.array().cast("array<array<struct<x:double,y:double>>>")).alias("parts"), F.col("f.properties").alias("tags"))


def read_layers(spark: SparkSession, folder: str, names=("water", "parks", "roads", "buildings")) -> DataFrame:
    """The named layers of a folder in one table with a layer column; a missing or unreadable file is an absent layer."""
    out = None
    for name in names:
        try:
            one = read_geojson(spark, f"{folder}/{name}.geojson").withColumn("layer", F.lit(name))
        except (AnalysisException, ValueError):
            continue
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>, tags map<string,string>, layer string")
    return out


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the tables that is there (Parquet, or GeoJSON lines by name); raises if none is. Longitude and latitude come
    from the geometry where they aren't columns."""
    for path in paths:
        try:
            if path.endswith("json"):
                df = read_geojson_lines(spark, path)
                df = df.withColumns({"longitude": F.col("parts")[0][0]["x"], "latitude": F.col("parts")[0][0]["y"]})
            else:
                df = spark.read.parquet(path)
        except AnalysisException:
            continue
        if {"longitude", "latitude"} <= set(df.columns):
            return df
        if "geometry" in df.columns:
            return df.withColumns(dict(zip(("longitude", "latitude"), wkb_point_xy(F.col("geometry")), strict=True)))
        raise ValueError(f"{path} has neither coordinates nor a geometry")
    raise FileNotFoundError(f"none of {paths}")


#: What each stage of the hotspot job reads, the first of those that are there: names in its own output folder, then in the folder of
#: intermediate tables; all end at the features (fixed names).
STAGE_INPUTS = {
    "delineation": (["module_1_stage1_aligned.parquet"], ["module_1_stage1_aligned.parquet"]),
    "anomaly": (["module_1_stage2_delineated.parquet"], ["module_1_stage2_delineated.parquet"]),
    "night": (["module_1_stage3_suhii.parquet"], ["module_1_stage3_suhii.parquet"]),
    "hotspots": (["module_1_stage4_nighttime.parquet"], ["module_1_stage4_nighttime.parquet"]),
    "clusters": (["module_1_stage5_hotspots.parquet"], ["module_1_stage5_hotspots.parquet"]),
    "percentiles": (["module_1_stage5_labeled.parquet"], ["module_1_stage5_labeled.parquet", "module_1_stage5_hotspots.parquet"]),
    "scores": (["module_1_stage5_pct.parquet"], ["module_1_stage5_pct.parquet", "module_1_stage5_labeled.parquet"]),
    "export": (
        ["module_1_stage5_scored.parquet", "module_1_stage5_hotspots.parquet"],
        ["module_1_stage5_scored.parquet", "module_1_stage5_pct.parquet", "module_1_stage5_labeled.parquet", "module_1_stage5_hotspots.parquet"],
    ),
}
#: Files that a task of write_folders keeps open, and Spark's setting for it.
FOLDERS, OPEN = 4, "spark.sql.maxConcurrentOutputFileWriters"
FEATURES = ["features.geoparquet", "features.parquet"]


def stage_candidates(stage: str, output: str, between: str, processed: str, own: str | None = None) -> list[str]:
    """Paths of a stage's input in the order in which they are tried; an input of its own comes first."""
    here, there = STAGE_INPUTS[stage]
    return [*([own] if own else []), *(f"{output}/{n}" for n in here), *(f"{between}/{n}" for n in there), *(f"{processed}/{n}" for n in FEATURES)]


def double_bytes(c: Column) -> Column:
    """The 8 bytes of a double, high byte first; both zeros are 0."""
    whole = c.cast("double") + 0.0
    bits = F.when(whole.isNotNull(), F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), whole).cast("long"))
    return F.unhex(F.lpad(F.hex(bits), 16, "0"))


def wkb_point(x: Column, y: Column) -> Column:
    """Well-known binary of a point (high byte first); NULL where a coordinate is."""
    return F.concat(F.unhex(F.lit("0000000001")), double_bytes(x), double_bytes(y))


def bytes_double(b: Column) -> Column:
    bits = F.conv(F.hex(b), 16, -10).cast("long")
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF).cast("long"))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1).cast("long")) / float(1 << 52)
    value = (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023)
    return F.when(bits == 0, F.lit(0.0)).when(bits < 0, -value).otherwise(value)


def wkb_point_xy(b: Column) -> tuple[Column, Column]:
    """Coordinates of a well-known binary point of either byte order."""
    low = F.hex(F.substring(b, 1, 1)) == "01"
    turned = lambda c: F.unhex(F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.hex(c), i * 2 + 1, F.lit(2)))), ""))
    out = []
    for at in (6, 14):
        raw = F.substring(b, at, 8)
        out.append(bytes_double(F.when(low, turned(raw)).otherwise(raw)))
    return out[0], out[1]


def write_folders(df: DataFrame, path: str, partition: tuple[str, ...] = ("run_id",)) -> None:
    """Parquet, a folder for each value of the partition's columns. A task keeps the files of its first FOLDERS folders open and sorts only rows of others,
    so a few large runs are written without a sort of whole rows."""
    spark = df.sparkSession
    before = spark.conf.get(OPEN, None)
    spark.conf.set(OPEN, str(FOLDERS))
    try:
        df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    finally:
        spark.conf.set(OPEN, before) if before is not None else spark.conf.unset(OPEN)


def write_points(df: DataFrame, path: str, partition: tuple[str, ...] = ("run_id",)) -> None:
    """Parquet with a WKB geometry, a folder a run; the reference system goes into a sidecar written by the job."""
    write_folders(df.withColumn("geometry", wkb_point(F.col("longitude"), F.col("latitude"))), path, partition)


def write_geojson(df: DataFrame, path: str, geometry: Column | None = None, leave: tuple[str, ...] = (), packed: bool = False) -> None:
    """One GeoJSON feature a line, with all columns as properties but binary ones and those to leave; packed: in gzip files, which read_geojson_lines takes too."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    shape = geometry if geometry is not None else point
    properties = F.struct(*(c for c, t in df.dtypes if t != "binary" and c not in leave))
    lines = df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))).alias("value"))
    how = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"} if packed else {}
    lines.write.mode("overwrite").options(**how).text(path)


def write_collections(df: DataFrame, path: str, geometry: Column, each: int = 1000) -> None:
    """Feature collections of features with near ids, a file each, with feature_id as property: what read_geojson takes."""
    one = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("feature_id").alias("properties"))
    own = df.groupBy(F.floor(F.col("feature_id") / each).alias("part")).agg(F.collect_list(one).alias("features"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("features")))
    own.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def polygon(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def square(x: Column, y: Column, d: float) -> Column:
    """Closed ring of the square of side d around a point."""
    h = d / 2
    return F.array(*(F.struct((x + i * h).alias("x"), (y + j * h).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    from emberlattice.sources.catalogue import WEATHER

    return spark.read.schema("date string, " + ", ".join(f"{c} double" for c, _ in WEATHER.values())).csv(path, header=True)


def write_weather_csv(days: DataFrame, path: str) -> None:
    """Weather with a header, in the columns that read_weather_csv takes."""
    from emberlattice.sources.catalogue import WEATHER

    days.select("date", *(c for c, _ in WEATHER.values())).write.mode("overwrite").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """A validation report, a JSON object a line; a later one replaces it."""
    report.write.mode("overwrite").json(path)


def file_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, checksum) of landed files: SHA-256 in the JVM."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("checksum"))


def valid_files(files: DataFrame, least: int = 10) -> DataFrame:
    """Adds whether each file has at least the least size."""
    return files.withColumn("valid", F.coalesce(F.col("length") >= least, F.lit(False)))
