"""Rasters as pixel tables (scene_id, band, row, col, value) with headers (scene_id, left, top, res_x, res_y, width, height, nodata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.functions import expressions as E


def pixel_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of the pixel that holds a point, from a header's columns."""
    return F.floor((F.col("top") - y) / F.col("res_y")).cast("int"), F.floor((x - F.col("left")) / F.col("res_x")).cast("int")


def sample(points: DataFrame, headers: DataFrame, pixels: DataFrame, x: str = "longitude", y: str = "latitude", clamp: bool = False, values=("value",)) -> DataFrame:
    """The pixel values at each point: points meet headers by scene_id, then pixels by row and column (clamped to the raster if asked).

    Nodata and points beside the raster give NULL; rows of scenes without a header keep NULL.
    """
    own = points.join(headers, "scene_id", "left")
    row, col = pixel_of(F.col(x), F.col(y))
    if clamp:
        row, col = (F.least(F.greatest(c, F.lit(0)), F.col(n) - 1) for c, n in ((row, "height"), (col, "width")))
    at = own.withColumn("p_row", row).withColumn("p_col", col)
    grid = pixels.select("scene_id", F.col("row").alias("p_row"), F.col("col").alias("p_col"), *values)
    joined = at.join(grid, ["scene_id", "p_row", "p_col"], "left")
    return joined.withColumns({v: F.nullif(F.col(v).cast("double"), F.col("nodata")) for v in values}).select(*points.columns, *values)


def stack_bands(bands: dict[str, DataFrame]) -> DataFrame:
    """Single-band pixel tables put together, with band numbers in the order given."""
    out = None
    for i, (name, df) in enumerate(bands.items(), 1):
        one = df.withColumn("band", F.lit(i)).withColumn("band_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def wide_bands(pixels: DataFrame, names: list[str]) -> DataFrame:
    """One row a pixel with a column a band, so that one join samples them all."""
    return pixels.groupBy("scene_id", "row", "col").pivot("band_name", names).agg(F.first("value"))


def crop(pixels: DataFrame, headers: DataFrame, lo_x: float, lo_y: float, hi_x: float, hi_y: float) -> DataFrame:
    """Pixels whose centres lie within the box."""
    own = pixels.join(headers.select("scene_id", "left", "top", "res_x", "res_y"), "scene_id")
    x, y = F.col("left") + (F.col("col") + 0.5) * F.col("res_x"), F.col("top") - (F.col("row") + 0.5) * F.col("res_y")
    return own.filter(x.between(lo_x, hi_x) & y.between(lo_y, hi_y)).select(*pixels.columns)


def gradient(pixels: DataFrame, value: str = "value", step_x: float | Column = 1.0, step_y: float | Column = 1.0) -> DataFrame:
    """Adds gx and gy: central differences inside, one-sided at the edges of rows and columns (0 where there is one pixel alone)."""
    out = pixels
    for name, part, order, step in (("gx", "row", "col", step_x), ("gy", "col", "row", step_y)):
        w = Window.partitionBy("scene_id", part).orderBy(order)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        ends = F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - here).when(after.isNull(), here - before)
        out = out.withColumn(name, ends.otherwise((after - before) / 2) / step)
    return out


def fill_elevation(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """Missing elevations take their scene's mean; 12 where a scene has none at all."""
    own = pixels.join(headers.select("scene_id", "nodata"), "scene_id").withColumn("value", F.nullif(F.col("value").cast("double"), F.col("nodata"))).drop("nodata")
    means = own.groupBy("scene_id").agg(F.coalesce(F.avg("value"), F.lit(12.0)).alias("mean"))
    return own.join(means, "scene_id").withColumn("value", F.coalesce("value", "mean")).drop("mean")


def terrain(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """Pixels with elevation, slope and aspect; steps in metres from each header."""
    mx, my = E.pixel_metres(F.col("res_x"), F.col("res_y"), F.col("top"), F.col("height"))
    steps = headers.select("scene_id", mx.alias("mx"), my.alias("my"))
    own = gradient(fill_elevation(pixels, headers).join(steps, "scene_id"), "value", F.col("mx"), F.col("my"))
    return own.select(
        "scene_id", "row", "col", E.clip(F.col("value"), 0.0, 1000.0).alias("elevation_m"), E.slope_degrees(F.col("gx"), F.col("gy")).alias("slope_deg"), E.aspect_degrees(F.col("gx"), F.col("gy")).alias("aspect_deg")
    )


def spectral_columns(df: DataFrame) -> DataFrame:
    """Indices from red, nir, swir, green and the surface temperature from lst; fills where missing."""
    c = F.col
    return df.withColumns(
        {
            "ndvi": F.coalesce(E.ndvi(c("red"), c("nir")), F.lit(E.NDVI_FILL)),
            "ndbi": F.coalesce(E.ndbi(c("swir"), c("nir")), F.lit(E.NDBI_FILL)),
            "ndwi": F.coalesce(E.ndwi(c("green"), c("nir")), F.lit(E.NDWI_FILL)),
            "lst_celsius": E.surface_temperature(c("lst")),
        }
    )


def synthetic(headers: DataFrame, kind: str, seed: int = 7) -> DataFrame:
    """Test rasters from hashes, the same whatever the partitions: 'bands' (4 uniform), 'temperature' (normal 33.5, 3), 'elevation'
    (uniform 2..45) or 'cover' (weighted classes)."""
    cells = headers.select("scene_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)).alias("i"))
    at = cells.select("scene_id", (F.col("i") / F.col("width")).cast("int").alias("row"), (F.col("i") % F.col("width")).cast("int").alias("col"), F.concat_ws("/", "scene_id", "i").alias("key"))
    u = E.hashed_uniform(F.col("key"), seed)
    if kind == "bands":
        spread = at.withColumn("band", F.explode(F.array(*map(F.lit, range(1, 5)))))
        return spread.withColumn("value", 0.05 + 0.55 * E.hashed_uniform(F.concat_ws("#", "key", "band"), seed)).drop("key")
    value = {
        "temperature": 33.5 + 3.0 * E.hashed_normal(F.col("key"), seed),
        "elevation": 2.0 + 43.0 * u,
        "cover": F.when(u < 0.5, 50.0).when(u < 0.7, 10.0).when(u < 0.85, 30.0).when(u < 0.95, 40.0).otherwise(80.0),
    }[kind]
    return at.withColumn("band", F.lit(1)).withColumn("value", value).drop("key")
