"""Scalar expressions: indices, fills, temperatures, classes. NULL stands for a missing value throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
METRES_PER_DEGREE = 111000.0
NDVI_FILL, NDBI_FILL, NDWI_FILL = 0.35, 0.15, -0.10
SURFACE_FILL, SCENE_FILL, DAY_FILL = 33.5, 32.0, 34.0
COVER_FILL, COVER_WATER, COVER_BUILT = 50, 80, 50
RURAL_COVERS = (10, 20, 30, 40, 60, 90, 95)


def clip(c: Column, low: float, high: float) -> Column:
    """c within low..high; NULL stays NULL, as least and greatest alone would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) within -1..1; NULL where the sum is 0."""
    return clip(F.try_divide(a - b, a + b), -1.0, 1.0)


def ndvi(red: Column, nir: Column) -> Column:
    return normalised_difference(nir, red)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalised_difference(swir, nir)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def surface_temperature(c: Column) -> Column:
    """Missing or below 10: 33.5; else within 15..55."""
    return F.when(c.isNull() | (c < 10), F.lit(SURFACE_FILL)).otherwise(clip(c, 15.0, 55.0))


def scene_celsius(number: Column) -> Column:
    """Digital number to degrees; outside 10..60 or missing: 32."""
    c = number * 0.00341802 + 149.0 - 273.15
    return F.when(c.between(10.0, 60.0), c).otherwise(F.lit(SCENE_FILL))


def slope_degrees(gx: Column, gy: Column) -> Column:
    return clip(F.degrees(F.atan(F.hypot(gx, gy))), 0.0, 60.0)


def aspect_degrees(gx: Column, gy: Column) -> Column:
    """Mathematical angle of the gradient from the grid's axes, 0..360."""
    return F.pmod(F.degrees(F.atan2(-gy, gx)) + 360.0, F.lit(360.0))


def elevation(value: Column, nodata: Column) -> Column:
    return F.coalesce(clip(F.nullif(value, nodata), 0.0, 1000.0), F.lit(12.0))


def land_cover(value: Column) -> Column:
    return F.coalesce(value, F.lit(COVER_FILL)).cast("int")


def degrees_to_metres(distance: Column) -> Column:
    return distance * METRES_PER_DEGREE


def pixel_metres(res_x: Column, res_y: Column, top: Column, height: Column) -> tuple[Column, Column]:
    """Pixel size of a raster in degrees: x shrinks with the cosine of the middle latitude."""
    middle = top - res_y * height / 2
    return res_x * METRES_PER_DEGREE * F.cos(F.radians(middle)), res_y * METRES_PER_DEGREE


def day_temperature(columns: list[str]) -> Column:
    """Of the columns that a table has: the day column, else the surface temperature, else 34."""
    for name in ("lst_day_celsius", "lst_celsius"):
        if name in columns:
            return clip(F.col(name), 15.0, 55.0)
    return F.lit(DAY_FILL)


def hashed_normal(key: Column, seed: int) -> Column:
    """Standard normal noise from the key's hash: the same whatever the partitions (Box-Muller)."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    v = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def hashed_uniform(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def night_temperature(noise_sd: float = 0.3, seed: int = 42) -> Column:
    """Model of the night temperature from density, cover and vegetation (defaults where a column's value is missing)."""
    density, green = F.coalesce("building_density", F.lit(0.2)), F.coalesce("ndvi", F.lit(0.3))
    built = F.when(F.coalesce("land_cover_code", F.lit(COVER_FILL)) == COVER_BUILT, 2.5).otherwise(0.0)
    model = 22.5 + 3.5 * density + built - clip(3.0 * green, 0.0, 4.0)
    return clip(model + noise_sd * hashed_normal(F.col("point_id"), seed) if noise_sd else model, 18.0, 36.0)


def masks() -> dict[str, Column]:
    """is_water, is_urban and is_rural; a missing value takes its column's default."""
    cover = F.coalesce("land_cover_code", F.lit(COVER_FILL))
    green, built = F.coalesce("ndvi", F.lit(0.3)), F.coalesce("ndbi", F.lit(0.1))
    wet, dense = F.coalesce("ndwi", F.lit(-0.1)), F.coalesce("building_density", F.lit(0.0))
    water = (cover == COVER_WATER) | (wet > 0.15)
    urban = ((cover == COVER_BUILT) | (built > 0.15) | (dense > 0.20)) & ~water
    return {"is_urban": urban, "is_rural": (cover.isin(*RURAL_COVERS) | (green >= 0.25)) & ~urban & ~water, "is_water": water}


def diurnal_range(day: Column, night: Column) -> Column:
    return clip(day - night, 0.0, 45.0)


def persistence_ratio(day: Column, night: Column) -> Column:
    return night / F.when(day == 0, F.lit(1.0)).otherwise(day)


def retention_class(ratio: Column, urban: Column) -> Column:
    """On the ratio before it is clipped; a missing one is Moderate."""
    return (
        F.when((ratio >= 0.65) & urban, "High Nocturnal Heat Retention")
        .when(ratio >= 0.55, "Moderate Retention")
        .when(ratio < 0.55, "Rapid Cooling")
        .otherwise("Moderate Retention")
    )


#: Coefficients, highest power first, of the rational form below 5 * sqrt(2) (Hart and West; fixed values).
NEAR_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NEAR_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _continued_fraction(last: float, steps: tuple[float, ...]) -> tuple[list[float], list[float]]:
    """x + s1 / (x + s2 / ... (x + last)) as a quotient of polynomials, highest power first; steps from the innermost."""
    top, low = [1.0, last], [1.0]
    for k in steps:
        shifted, scaled = [*top, 0.0], [0.0] * (len(top) + 1 - len(low)) + [k * c for c in low]
        top, low = [a + b for a, b in zip(shifted, scaled, strict=True)], top
    return top, low


FAR_LOW, FAR_TOP = _continued_fraction(0.65, (4.0, 3.0, 2.0, 1.0))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) in double precision; a missing z counts as 1. Each branch is a quotient of polynomials, with one division and one exponential for all,
    so that the generated code stays small."""
    x = F.abs(z)

    def horner(coefficients) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    near = x < 7.07106781186547
    top = F.when(near, horner(NEAR_TOP)).otherwise(horner(FAR_TOP))
    low = F.when(near, horner(NEAR_LOW)).otherwise(horner([2.506628274631 * c for c in FAR_LOW]))
    tail = F.when(x > 37, 0.0).otherwise(F.exp(-x * x / 2) * top / low)
    return F.coalesce(F.abs(F.when(z > 0, 0.0).otherwise(1.0) - tail), F.lit(1.0))


def significance(z: Column, p: Column) -> Column:
    return F.when((z > 2.58) & (p < 0.01), 99).when((z > 1.96) & (p < 0.05), 95).cast("int")


def hotspot_class(day_sig: Column, night_sig: Column, z_day: Column, z_night: Column) -> Column:
    day, night = F.coalesce(day_sig, F.lit(0)), F.coalesce(night_sig, F.lit(0))
    return (
        F.when((day == 99) & (night == 99), "99% Confidence Persistent Hotspot")
        .when((day >= 95) & (night >= 95), "95% Confidence Persistent Hotspot")
        .when((day >= 95) | (night >= 95), "95% Confidence Hotspot (Day or Night)")
        .when((z_day < -1.96) | (z_night < -1.96), "Coldspot Cluster")
        .otherwise("Not Significant / Noise")
    )


def composite(day: Column, night: Column) -> Column:
    """The larger of both; missing if either is."""
    return F.when(day.isNotNull() & night.isNotNull(), F.greatest(day, night))


def min_max(c: Column, low: Column, high: Column, default: float = 0.0) -> Column:
    """c scaled to 0..1; all equal: 0.5; missing: 0; no value at all: default."""
    return (
        F.when(low.isNull(), F.lit(default)).when(c.isNull(), 0.0).when(high == low, 0.5).otherwise((c - low) / (high - low))
    )


#: Confidence tiers from the highest: least score and name.
TIERS = ((95, "Critical"), (80, "Very High"), (60, "High"), (40, "Moderate"), (20, "Low"), (0, "Very Low"))
#: Weights of the score: clustering, anomaly, persistence, temperature percentile.
WEIGHTS = (0.45, 0.30, 0.15, 0.10)


def tier(score: Column, tiers=TIERS) -> Column:
    out = F.lit(None).cast("string")
    for least, name in sorted(tiers):
        out = F.when(score >= least, name).otherwise(out)
    return out


def area_km2(count: Column, cell_m: float = 100.0) -> Column:
    return F.round(count * (cell_m * cell_m / 1e6), 2)


def cluster_name(number: Column) -> Column:
    return F.format_string("HOT_%04d", number)


def place_text(*parts: Column) -> Column:
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))
