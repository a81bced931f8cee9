"""Gates and reports: summaries of each stage, layer checks, the 20-check report, the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.functions import expressions as E
from emberlattice.operators.thermal import CLUSTER_COLUMNS, FORBIDDEN_COLUMNS, KEYS, LAYER_COLUMNS, MANDATORY_COLUMNS, quantiles

#: Keys of a complete metadata record (fixed contract).
METADATA_KEYS = [
    "dataset_name", "source", "provider", "download_time", "projection", "bounding_box", "resolution", "file_size_bytes", "license", "version", "checksum",
    "storage_path", "status",
]
ALIGNED_COLUMNS = ["point_id", "latitude", "longitude", "ndvi", "ndbi", "ndwi", "lst_day_celsius", "lst_night_celsius", "land_cover_code", "utm_x_m", "utm_y_m"]
CLASSES = [name for _, name in E.TIERS]


def n_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def mean_if(c: str, mask: str | Column) -> Column:
    return F.avg(F.when(F.col(mask) if isinstance(mask, str) else mask, F.col(c)))


def mask_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    """Counts, areas, urban and rural means, their differences; valid: at least 1 urban and 10 rural points."""
    mean = {(m, t): mean_if(f"lst_{t}_celsius", f"is_{m}") for m in ("urban", "rural") for t in ("day", "night")}
    counts = {m: n_if(F.col(f"is_{m}")) for m in ("urban", "rural", "water")}
    return df.groupBy(*keys).agg(
        *(c.alias(f"n_{m}") for m, c in counts.items()),
        *(E.area_km2(counts[m]).alias(f"{m}_km2") for m in ("urban", "rural")),
        *(F.round(v, 2).alias(f"{m}_mean_{t}") for (m, t), v in mean.items()),
        *(F.round(mean["urban", t] - mean["rural", t], 2).alias(f"delta_{t}") for t in ("day", "night")),
        ((counts["urban"] >= 1) & (counts["rural"] >= 10)).alias("valid"),
    )


def anomaly_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    urban = lambda c: F.when(F.col("is_urban"), F.col(c))
    out = {}
    for t in ("day", "night"):
        c = f"suhii_{t}_celsius"
        out |= {f"urban_mean_{t}": F.avg(urban(c)), f"urban_max_{t}": F.max(urban(c))}
    positive = F.coalesce(out["urban_mean_day"] > 0, F.lit(False)) | F.coalesce(out["urban_mean_night"] > 0, F.lit(False))
    means = df.groupBy(*keys).agg(*(F.round(v, 4).alias(k) for k, v in out.items()), F.when(positive, "PASSED").otherwise("PASSED_WITH_NO_ANOMALY").alias("status"))
    tops = [f"urban_p95_{t}" for t in ("day", "night")]
    top = quantiles(df, {n: urban(f"suhii_{n.rsplit('_', 1)[-1]}_celsius") for n in tops}, 0.95, keys)
    top = top.select(*(F.col(k).alias(f"of_{k}") for k in keys), *(F.round(n, 4).alias(n) for n in tops))
    joined = means.join(top, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], "left")
    return joined.select(*keys, *(f"urban_{v}_{t}" for t in ("day", "night") for v in ("mean", "max", "p95")), "status")


def night_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    value = lambda c, m, d: F.coalesce(mean_if(c, m), F.lit(d))
    ratio = {m: value("heat_persistence_index", f"is_{m}", 0.50) for m in ("urban", "rural")}
    high = n_if(F.col("thermal_retention_class") == "High Nocturnal Heat Retention")
    return df.groupBy(*keys).agg(
        *(F.round(v, 3).alias(f"{m}_mean_hpi") for m, v in ratio.items()),
        *(F.round(value("delta_lst_diurnal", f"is_{m}", d), 2).alias(f"{m}_mean_range") for m, d in (("urban", 10.0), ("rural", 15.0))),
        high.alias("high_retention_points"),
        E.area_km2(high).alias("high_retention_km2"),
        F.round(ratio["urban"] - ratio["rural"], 3).alias("hpi_delta"),
        (ratio["urban"] > 0).alias("valid"),
    )


def hotspot_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    day, night = F.col("day_hotspot_significance"), F.col("night_hotspot_significance")
    good = n_if(F.col("is_validated_hotspot"))
    return df.groupBy(*keys).agg(
        good.alias("validated"),
        *(n_if(c == v).alias(f"{w}_{v}") for w, c in (("day", day), ("night", night)) for v in (95, 99)),
        n_if((day == 99) & (night == 99)).alias("persistent_99"),
        E.area_km2(good).alias("validated_km2"),
        F.round(mean_if("suhii_day_celsius", "is_validated_hotspot"), 2).alias("hotspot_mean_suhii"),
        (F.count("*") - good).alias("discarded"),
        (good >= 0).alias("valid"),
    )


def score_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    s = F.col("hotspot_confidence_score")
    return df.groupBy(*keys).agg(
        F.count(s).alias("scored"), *(F.round(f(s), 2).alias(n) for n, f in (("mean_score", F.avg), ("max_score", F.max), ("min_score", F.min))),
        *(n_if(F.col("confidence_class") == c).alias("n_" + c.lower().replace(" ", "_")) for c in CLASSES),
    )


def percentile_summary(df: DataFrame, keys=KEYS) -> DataFrame:
    p = F.col("city_temperature_percentile")
    return df.groupBy(*keys).agg(F.count(p).alias("evaluated"), F.count("*").alias("total"), F.max(p).alias("max_percentile"), F.min(p).alias("min_percentile"))


def cluster_count(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct("hotspot_id").alias("clusters"), F.count("hotspot_id").alias("labelled"))


def null_counts(df: DataFrame, columns: list[str], keys=KEYS) -> DataFrame:
    """Missing values of each column and in all, in one pass."""
    one = {c: F.sum(F.col(c).isNull().cast("long")) for c in columns}
    return df.groupBy(*keys).agg(*(v.alias(f"nulls_{c}") for c, v in one.items()), sum(list(one.values())[1:], next(iter(one.values()))).alias("nulls"))


def cover_codes(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set("land_cover_code")).alias("codes"))


def utm_check(df: DataFrame, x: str = "utm_x_m", y: str = "utm_y_m", keys=KEYS) -> DataFrame:
    """Whether projected coordinates are there and within 50,000..1,000,000 and 0..10,000,000."""
    missing = n_if(F.col(x).isNull() | F.col(y).isNull() | F.isnan(x) | F.isnan(y))
    inside = (F.min(x) >= 50_000) & (F.max(x) <= 1_000_000) & (F.min(y) >= 0) & (F.max(y) <= 10_000_000)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), missing.alias("missing"), ((F.count("*") > 0) & (missing == 0) & F.coalesce(inside, F.lit(False))).alias("valid"))


def alignment_gate(df: DataFrame, keys=KEYS) -> DataFrame:
    """Stage 1: the required columns are there and full, day within 10..60, night within 10..45."""
    there = [c for c in ALIGNED_COLUMNS if c in df.columns]
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in there), F.lit(0).cast("long"))
    ranges = [F.coalesce(F.min(c) >= lo, F.lit(False)) & F.coalesce(F.max(c) <= hi, F.lit(False)) for c, lo, hi in (("lst_day_celsius", 10.0, 60.0), ("lst_night_celsius", 10.0, 45.0)) if c in there]
    complete = F.lit(len(there) == len(ALIGNED_COLUMNS) and len(ranges) == 2)
    good = complete & (nulls == 0)
    for r in ranges:
        good &= r
    return df.groupBy(*keys).agg(F.count("*").alias("n"), nulls.alias("nulls"), good.alias("valid"))


def require(report: DataFrame, what: str) -> None:
    """Stops a job at a gate: raises if any run's report is not valid."""
    bad = report.filter(~F.coalesce("valid", F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")


def layer_report(layer: DataFrame, clusters: DataFrame, srid: int = 4326, keys=KEYS) -> DataFrame:
    """The 20 checks of the final layer and registry, one map a run, from one pass over each, and one by point for those in two clusters."""
    has = set(layer.columns)
    c = F.col
    p = c("city_temperature_percentile")
    land = ~c("is_water")
    all_ = lambda cond: n_if(~F.coalesce(cond, F.lit(False))) == 0
    coords = all_(c("latitude").between(-90, 90)) & all_(c("longitude").between(-180, 180))
    utm = all_(c("utm_x_m").between(50_000, 1_000_000)) & all_(c("utm_y_m").between(0, 10_000_000))
    expected = n_if(land & c("lst_day_celsius").isNotNull())
    points = {
        "required_columns_exist": F.lit(set(LAYER_COLUMNS) <= has),
        "no_forbidden_duplicate_fields": F.lit(not set(FORBIDDEN_COLUMNS) & has),
        "coordinates_valid": coords,
        "utm_coordinates_projected_valid": utm,
        "crs_valid": F.lit(srid == 4326),
        "surface_masks_consistent": n_if((c("is_urban") & c("is_water")) | (c("is_rural") & c("is_water")) | (c("is_urban") & c("is_rural"))) == 0,
        "water_excluded_from_temperature_percentiles": n_if(c("is_water") & p.isNotNull()) == 0,
        "temperature_percentiles_within_0_100": n_if(land & ~p.between(0, 100)) == 0,
        "temperature_rank_valid": n_if(land & (c("temperature_rank") < 1)) == 0,
        "temperature_total_pixels_consistent": (F.min("temperature_total_pixels") == expected) & (F.max("temperature_total_pixels") == expected),
        "confidence_scores_within_0_100": n_if(~c("hotspot_confidence_score").between(0, 100)) == 0,
        "confidence_classes_valid": F.size(F.array_except(F.collect_set("confidence_class"), F.array(*map(F.lit, CLASSES)))) == 0,
        "no_redundant_cluster_metadata_in_points": F.lit(not set(CLUSTER_COLUMNS) & has),
        "geometries_valid": all_(c("longitude").isNotNull() & c("latitude").isNotNull()),
        "mandatory_fields_complete": sum((F.sum(c(m).isNull().cast("long")) for m in MANDATORY_COLUMNS), F.lit(0).cast("long")) == 0,
        "spatial_alignment_compatible": F.lit(srid == 4326) & coords & utm,
    }
    rows = clusters.groupBy(*keys).agg(
        (F.count("hotspot_id") == F.countDistinct("hotspot_id")).alias("hotspot_ids_unique_in_registry"),
        all_(c("cluster_area_m2") > 0).alias("cluster_areas_positive"),
        all_(c("cluster_perimeter_m") > 0).alias("cluster_perimeters_positive"),
        F.count("*").alias("clusters"),
    )
    own = layer.groupBy(*keys).agg(*(v.alias(k) for k, v in points.items()), F.count("*").alias("points"), F.count("hotspot_id").alias("hotspot_points"), expected.alias("land"))
    single = "single_hotspot_membership_per_point"
    member = layer.filter(c("hotspot_id").isNotNull()).groupBy(*keys, "point_id").agg((F.min("hotspot_id") == F.max("hotspot_id")).alias(single)).groupBy(*keys).agg(F.min(single).alias(single))
    joined = own.join(rows, list(keys), "left").join(member, list(keys), "left")
    names = [*points, single, "hotspot_ids_unique_in_registry", "cluster_areas_positive", "cluster_perimeters_positive"]
    checks = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(c(n), F.lit(True)) for n in names)))
    out = joined.select(*keys, checks.alias("checks"), "points", F.coalesce("clusters", F.lit(0)).alias("clusters"), "hotspot_points", "land")
    return out.withColumn("valid", F.forall(F.map_values("checks"), lambda v: v))


def manifest(layer: DataFrame, clusters: DataFrame, keys=KEYS) -> DataFrame:
    """Totals, areas, urban means and the provenance of the first point."""
    first = lambda col: F.min_by(col, "point_id").alias(col)
    own = layer.groupBy(*keys).agg(
        F.count("*").alias("total_sample_points"),
        E.area_km2(n_if(F.col("is_urban"))).alias("urban_area_km2"),
        E.area_km2(n_if(F.col("is_rural"))).alias("rural_baseline_area_km2"),
        E.area_km2(F.count("hotspot_id")).alias("validated_hotspot_area_km2"),
        *(F.round(F.coalesce(mean_if(f"suhii_{t}_celsius", "is_urban"), F.lit(0.0)), 2).alias(f"urban_mean_{t}_suhii_celsius") for t in ("day", "night")),
        *map(first, ("sensor", "capture_date", "scene_id", "processing_version")),
    )
    count = clusters.groupBy(*keys).agg(F.count("*").alias("total_hotspot_clusters"))
    return own.join(count, list(keys), "left").withColumn("total_hotspot_clusters", F.coalesce("total_hotspot_clusters", F.lit(0)))


def layer_check(shapes: DataFrame, expected_srid: int = 4326, keys=("layer",)) -> DataFrame:
    """Vector layers (layer, geometry, srid): empty, wrong system, null and repeated shapes; PASSED or WARNING with the issues."""
    g = F.col("geometry")
    nulls = F.sum(g.isNull().cast("long"))
    repeats = F.count(g) - F.countDistinct(g) + F.greatest(nulls - 1, F.lit(0))
    counted = shapes.groupBy(*keys).agg(F.count("*").alias("features"), nulls.alias("nulls"), repeats.alias("repeats"), n_if(F.col("srid") != expected_srid).alias("other_srid"))
    issues = F.filter(
        F.array(F.when(F.col("other_srid") > 0, "crs_mismatch"), F.when(F.col("nulls") > 0, "null_geometries"), F.when(F.col("repeats") > 0, "duplicate_geometries")), lambda x: x.isNotNull()
    )
    return counted.withColumn("issues", F.concat_ws(",", issues)).withColumn("status", F.when(F.col("issues") == "", "PASSED").otherwise("WARNING"))


def raster_check(headers: DataFrame, pixels: DataFrame) -> DataFrame:
    """Headers (scene_id, left, top, res_x, res_y, width, height, bands) against their pixels."""
    counts = pixels.groupBy("scene_id").agg(F.count("*").alias("pixels"))
    sane = (F.col("width") > 0) & (F.col("height") > 0) & F.col("left").isNotNull() & F.col("top").isNotNull() & ~F.isnan("left") & ~F.isnan("top")
    whole = F.coalesce("pixels", F.lit(0)) == F.col("width") * F.col("height") * F.col("bands")
    return headers.join(counts, "scene_id", "left").select("scene_id", F.coalesce("pixels", F.lit(0)).alias("pixels"), F.when(sane & whole, "PASSED").otherwise("FAILED").alias("status"))


def weather_check(df: DataFrame) -> DataFrame:
    if "temperature_2m_c" not in df.columns:
        return df.agg(F.count("*").alias("days"), F.lit("WARNING").alias("status"))
    return df.agg(F.count("*").alias("days"), F.when(F.count("*") == 0, "WARNING").otherwise("PASSED").alias("status"))


def metadata_check(records: DataFrame, record: str = "record", key: str = "dataset_name") -> DataFrame:
    """Records (key, map): which required keys are missing."""
    missing = F.array_except(F.array(*map(F.lit, METADATA_KEYS)), F.map_keys(record))
    return records.select(key, F.concat_ws(",", missing).alias("missing")).withColumn("status", F.when(F.col("missing") == "", "PASSED").otherwise("WARNING"))


def overall(checks: DataFrame, status: str = "status") -> DataFrame:
    """PASSED if no check failed, else PASSED_WITH_WARNINGS."""
    failed = n_if(F.col(status) == "FAILED")
    return checks.agg(F.count("*").alias("checks"), failed.alias("failed"), F.when(failed == 0, "PASSED").otherwise("PASSED_WITH_WARNINGS").alias("status"))
