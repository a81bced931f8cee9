"""Catalogues: scenes, map layers by tags, weather, metadata records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.operators.spatial import tiles_of_box
from emberlattice.scratch import dealt, written

#: Which tags put a feature in which layer: any value (None) or one of a list, any key (fixed contract).
LAYER_TAGS = {
    "roads": {"highway": None},
    "buildings": {"building": None},
    "water": {"natural": ["water", "bay", "wetland"], "waterway": None},
    "parks": {"leisure": ["park", "garden", "playground", "nature_reserve"]},
    "vegetation": {"landuse": ["forest", "meadow", "grass", "allotments"], "natural": ["wood", "scrub", "grassland"]},
    "railways": {"railway": None},
    "landuse": {"landuse": None},
}

#: Weather parameters, their columns, and the constant day used without data (fixed contract).
WEATHER = {
    "T2M": ("temperature_2m_c", 28.5), "RH2M": ("relative_humidity_2m_pct", 75.0), "WS2M": ("wind_speed_2m_ms", 3.2), "WD2M": ("wind_direction_2m_deg", 180.0),
    "PRECTOTCORR": ("rainfall_mm_day", 2.5), "ALLSKY_SWRAD_DAILY": ("solar_radiation_mj_m2_day", 18.5), "PS": ("pressure_kpa", 101.3), "CLRSKY_DAYS": ("cloud_cover_clear_days", 15.0),
}


def weather_days(documents: DataFrame, json_col: str = "json", keys=()) -> DataFrame:
    """JSON {parameter: {yyyyMMdd: value}} to a row a day with a column a parameter."""
    parsed = documents.select(*keys, F.from_json(json_col, "map<string,map<string,double>>").alias("m"))
    values = parsed.select(*keys, F.explode("m").alias("parameter", "days")).select(*keys, "parameter", F.explode("days").alias("date", "value"))
    wide = values.groupBy(*keys, "date").pivot("parameter", list(WEATHER)).agg(F.first("value"))
    return wide.select(*keys, "date", *(F.col(p).alias(c) for p, (c, _) in WEATHER.items()))


def weather_fallback(spans: DataFrame, start: str = "start", end: str = "end", keys=()) -> DataFrame:
    """A constant row for each day from start to end, both included."""
    days = spans.select(*keys, F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))
    return days.select(*keys, compact_date(F.col("day")).alias("date"), *(F.lit(v).alias(c) for c, v in WEATHER.values()))


def compact_date(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def tag_layers(features: DataFrame, tags: str = "tags", layers=LAYER_TAGS) -> DataFrame:
    """A row for each layer that a feature's tags put it in."""

    def rule(conditions: dict) -> Column:
        out = F.lit(False)
        for key, wanted in conditions.items():
            value = F.col(tags)[key]
            out |= value.isNotNull() if wanted is None else F.coalesce(value.isin(wanted), F.lit(False))
        return out

    found = F.filter(F.array(*(F.when(rule(c), F.lit(name)) for name, c in layers.items())), lambda x: x.isNotNull())
    return features.withColumn("layer", F.explode(found))


def search(catalogue: DataFrame, asks: DataFrame, keys=("ask_id",), tile: float = 10.0) -> DataFrame:
    """Scenes for each ask: rows of attempts (keys, attempt, collection, lo_x, lo_y, hi_x, hi_y, from_ts, to_ts, max_cloud); of an ask's attempts the
    first that finds anything counts. Null dates or cloud limits set no bound; a scene without cloud cover counts as 100.

    Boxes meet by collection and tile; a pair counts in the tile that holds the lower corner of what they share, so once. A round an attempt finds the
    asks that it settles, by semi-joins that stop at a scene; pairs are made only for the attempt that counts, and none is shuffled.
    """
    asks, settled = written(asks, "asks"), None
    attempts = sorted(r[0] for r in asks.select("attempt").distinct().filter("attempt is not null").collect())  # a few
    for attempt in attempts:
        own = asks.filter(F.col("attempt") == attempt)
        own = own if settled is None else own.join(settled, list(keys), "left_anti")
        hits = written(meeting(catalogue, own, tile, "left_semi").select(*keys, "attempt").distinct(), f"settled-{attempt}")
        settled = hits if settled is None else settled.unionByName(hits)
    if settled is None:
        settled = asks.select(*keys, "attempt").limit(0)
    return meeting(catalogue, asks.join(settled, [*keys, "attempt"]), tile, "inner").select(*(f"a.{k}" for k in keys), "a.attempt", *(f"s.{n}" for n in catalogue.columns))


def meeting(catalogue: DataFrame, asks: DataFrame, tile: float, how: str) -> DataFrame:
    """Asks (a) joined with the scenes (s) that answer them. Scenes that no ask of their collection could take, by date or cloud, are left out before."""
    cloud = lambda n: F.coalesce(n, F.lit(100.0))
    bound = lambda f, n: F.when(F.count_if(F.col(n).isNull()) == 0, f(n)).alias(n)
    widest = asks.groupBy("collection").agg(bound(F.min, "from_ts"), bound(F.max, "to_ts"), bound(F.max, "max_cloud"))

    def fits(s: str, a: str) -> Column:
        own, ask = lambda n: F.col(f"{s}.{n}"), lambda n: F.col(f"{a}.{n}")
        limits = own("capture_ts") >= ask("from_ts"), own("capture_ts") <= ask("to_ts"), cloud(f"{s}.cloud_cover") < ask("max_cloud")
        return reduce(and_, (F.coalesce(c, ask(n).isNull()) for c, n in zip(limits, ("from_ts", "to_ts", "max_cloud"))))

    useful = catalogue.alias("s").join(F.broadcast(widest).alias("w"), (F.col("s.collection") == F.col("w.collection")) & fits("s", "w"), "left_semi")
    cover = lambda df: df.select("*", tiles_of_box(F.col("lo_x"), F.col("lo_y"), F.col("hi_x"), F.col("hi_y"), tile).alias("t"))
    s, a = dealt(cover(useful)).alias("s"), dealt(cover(asks)).alias("a")
    same = (F.col("s.collection") == F.col("a.collection")) & (F.col("s.t.tx") == F.col("a.t.tx")) & (F.col("s.t.ty") == F.col("a.t.ty"))
    overlap = (F.col("s.lo_x") <= F.col("a.hi_x")) & (F.col("s.hi_x") >= F.col("a.lo_x")) & (F.col("s.lo_y") <= F.col("a.hi_y")) & (F.col("s.hi_y") >= F.col("a.lo_y"))
    for v in ("x", "y"):
        overlap &= F.floor(F.greatest(f"s.lo_{v}", f"a.lo_{v}") / tile) == F.col(f"s.t.t{v}")
    return a.join(s, same & overlap & fits("s", "a"), how)


def first_found(catalogue: DataFrame, asks: DataFrame, order: list[Column], keys=("ask_id",), tile: float = 10.0) -> DataFrame:
    """Of each ask the first scene that it finds (search), by an order of the catalogue: (keys, attempt, the scene's columns).

    Scenes get numbers in that order from range partitions, so a pair is a number and the least one of an ask is kept where pairs are made: these
    are neither sorted nor shuffled."""
    ranged = written(catalogue.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "places")
    least = search(ranged, asks, keys, tile).groupBy(*keys).agg(F.min("attempt").alias("attempt"), F.min("place").alias("place"))
    return dealt(least).join(dealt(ranged), "place").select(*keys, "attempt", *catalogue.columns)


def best_scene(catalogue: DataFrame, asks: DataFrame, keys=("ask_id",)) -> DataFrame:
    """Of each ask the scene with the least cloud cover (missing: 100), then the smallest id."""
    return first_found(catalogue, asks, [F.coalesce("cloud_cover", F.lit(100.0)), F.col("scene_id")], keys)


def first_scene(catalogue: DataFrame, asks: DataFrame, keys=("ask_id",)) -> DataFrame:
    """Of each ask the scene with the smallest id."""
    return first_found(catalogue, asks, [F.col("scene_id")], keys)


def largest_file(files: DataFrame, keys=("sensor",), least: int = 100_000) -> DataFrame:
    """The largest file of each sensor, of those above the least size; ties go to the smaller path."""
    kept = files.filter(F.col("length") > least)
    return kept.groupBy(*keys).agg(F.max("length").alias("length"), F.max_by("path", F.struct("length", F.reverse("path"))).alias("any")).join(
        kept.select(*keys, "length", "path"), [*keys, "length"]
    ).groupBy(*keys, "length").agg(F.min("path").alias("path"))


def latest(records: DataFrame, key: str = "dataset_name", order: tuple[str, ...] = ("download_time",)) -> DataFrame:
    """The last record of each dataset of an append-only table."""
    own = records.groupBy(key).agg(F.max_by(F.struct(*(c for c in records.columns if c != key)), F.struct(*order)).alias("r"))
    return own.select(key, "r.*")


def complete(record: Column, keys: list[str]) -> Column:
    """A metadata map with "N/A" for required keys that it lacks."""
    return F.map_concat(F.map_from_arrays(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(record)), F.transform(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(record)), lambda _: F.lit("N/A"))), record)
