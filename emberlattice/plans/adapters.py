"""The driver's tables seen as points, rasters, shapes and catalogues; each with the same view in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a lattice of 100 columns with temperatures, cover and indices."""
    k = F.col("o_orderkey")
    col, row = (k % 100).cast("int"), F.floor(k / 100).cast("int")
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    cover = F.element_at(F.array(*map(F.lit, (10, 50, 80, 30, 60))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return own.select(
        F.lit("r0").alias("run_id"),
        F.concat(F.lit("pt_"), F.lpad(k.cast("string"), 9, "0")).alias("point_id"),
        col.alias("gx"),
        row.alias("gy"),
        (80.1 + col * 0.0009).alias("longitude"),
        (13.0 + row * 0.0009).alias("latitude"),
        (400000.0 + col * 100.0).alias("utm_x_m"),
        (1440000.0 + row * 100.0).alias("utm_y_m"),
        (20.0 + F.col("o_totalprice") / 20000.0 + 4.0 * F.sin(col / 9.0) * F.cos(row / 11.0)).alias("lst_day_celsius"),
        (18.0 + (F.col("o_custkey") % 100) / 10.0).alias("lst_night_celsius"),
        cover.alias("land_cover_code"),
        ((k * 7 % 200) / 100.0 - 1.0).alias("ndvi"),
        ((k * 11 % 200) / 100.0 - 1.0).alias("ndbi"),
        ((k * 13 % 120) / 100.0 - 1.0).alias("ndwi"),
        ((k * 3 % 100) / 400.0).alias("building_density"),
    )


CELLS = """cells AS (
    SELECT 'r0' AS run_id, 'pt_' || lpad(o_orderkey::VARCHAR, 9, '0') AS point_id, (o_orderkey % 100)::INTEGER AS gx, (o_orderkey // 100)::INTEGER AS gy,
        80.1::DOUBLE + gx::DOUBLE * 0.0009::DOUBLE AS longitude, 13.0::DOUBLE + gy::DOUBLE * 0.0009::DOUBLE AS latitude,
        400000.0::DOUBLE + gx * 100.0::DOUBLE AS utm_x_m, 1440000.0::DOUBLE + gy * 100.0::DOUBLE AS utm_y_m,
        20.0::DOUBLE + o_totalprice / 20000.0::DOUBLE + 4.0::DOUBLE * sin(gx / 9.0::DOUBLE) * cos(gy / 11.0::DOUBLE) AS lst_day_celsius,
        18.0::DOUBLE + (o_custkey % 100) / 10.0::DOUBLE AS lst_night_celsius,
        ([10, 50, 80, 30, 60])[o_orderpriority[1]::INTEGER] AS land_cover_code,
        (o_orderkey * 7 % 200) / 100.0::DOUBLE - 1.0::DOUBLE AS ndvi, (o_orderkey * 11 % 200) / 100.0::DOUBLE - 1.0::DOUBLE AS ndbi,
        (o_orderkey * 13 % 120) / 100.0::DOUBLE - 1.0::DOUBLE AS ndwi, (o_orderkey * 3 % 100) / 400.0::DOUBLE AS building_density
    FROM orders
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raster of 100 columns; every 37th pixel has no data."""
    k = F.col("o_orderkey")
    value = F.when(k % 37 == 0, F.lit(-9999.0)).otherwise(F.col("o_totalprice") / 1000.0)
    return table(spark, sf_dir, "orders").select(F.lit("s0").alias("scene_id"), F.lit(1).alias("band"), F.floor(k / 100).cast("int").alias("row"), (k % 100).cast("int").alias("col"), value.alias("value"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("n"))
    return count.select(
        F.lit("s0").alias("scene_id"), F.lit(80.1).alias("left"), F.lit(14.5).alias("top"), F.lit(0.0009).alias("res_x"), F.lit(0.0009).alias("res_y"),
        F.lit(100).alias("width"), F.ceil(F.col("n") / 100).cast("int").alias("height"), F.lit(1).alias("bands"), F.lit(-9999.0).alias("nodata"),
    )


PIXELS = """pixels AS (
    SELECT 's0' AS scene_id, (o_orderkey // 100)::INTEGER AS r, (o_orderkey % 100)::INTEGER AS c,
        CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_totalprice / 1000.0::DOUBLE END AS value FROM orders
), header AS (SELECT 80.1::DOUBLE AS lft, 14.5::DOUBLE AS top, 0.0009::DOUBLE AS res, 100 AS width, ceil((max(o_orderkey) + 1) / 100.0)::INTEGER AS height FROM orders)"""


def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points off the pixel corners, some beside the raster."""
    own = table(spark, sf_dir, "lineitem")
    return own.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("point_id"), F.lit("s0").alias("scene_id"),
        (80.1 + ((F.col("l_partkey") % 104) + 0.3) * 0.0009).alias("longitude"), (14.5 - ((F.col("l_suppkey") % 40) + 0.7) * 0.0009).alias("latitude"),
    )


SAMPLES = """samples AS (
    SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS point_id, (l_partkey % 104)::INTEGER AS c, (l_suppkey % 40)::INTEGER AS r FROM lineitem
)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as roads (lines), water and parks (boxes) in degrees."""
    k = F.col("p_partkey")
    x, y = 80.1 + (k * 37 % 1000) * 0.0001, 13.0 + (k * 53 % 1000) * 0.0001
    w, h = 0.0001 + (k % 7) * 0.0001, 0.0001 + (k % 5) * 0.0001
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    line, box = F.array(v(x, y), v(x + w, y + h)), F.array(v(x, y), v(x + w, y), v(x + w, y + h), v(x, y + h), v(x, y))
    own = table(spark, sf_dir, "part").select(k, x.alias("x"), y.alias("y"), line.alias("line"), box.alias("box"))
    layer = F.element_at(F.array(*map(F.lit, ("roads", "water", "parks"))), (k % 3 + 1).cast("int"))
    return own.select(
        k.alias("feature_id"), layer.alias("layer"), F.when(layer == "roads", "line").otherwise("polygon").alias("geom_type"),
        F.array(F.when(layer == "roads", F.col("line")).otherwise(F.col("box"))).alias("parts"), F.lit(4326).alias("srid"),
    )


def rough_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes of which most are faulty, by their key modulo 9: none, no parts, open, three corners, not a number, a spike, a box gone round twice, sound with a point
    twice, sound."""
    k = F.col("p_partkey")
    x, y = k * 1.0, k * 2.0
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    p, q, r, s = v(x, y), v(x + 1, y), v(x + 1, y + 1), v(x, y + 1)
    one, faults = [p, q, r, s, p], {2: [p, q, r, s], 3: [p, q, p], 4: [p, q, v(F.lit(float("nan")), y), s, p], 5: [p, q, r, v(x + 2, y + 1), r, s, p], 6: [p, q, r, s, p, q, r, s, p], 7: [p, q, q, r, s, p]}
    part = F.array(*one)
    for fault, corners in faults.items():
        part = F.when(k % 9 == fault, F.array(*corners)).otherwise(part)
    parts = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.array(part))
    return table(spark, sf_dir, "part").select(k.alias("feature_id"), F.lit("polygon").alias("geom_type"), parts.alias("parts"))


def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), (80.1 + (k * 71 % 1009) * 0.0001 + 0.00003).alias("longitude"), (13.0 + (k * 89 % 1013) * 0.0001 + 0.00004).alias("latitude"))


SHAPES = """shapes AS (
    SELECT p_partkey AS feature_id, ['roads', 'water', 'parks'][(p_partkey % 3 + 1)::INTEGER] AS layer,
        80.1::DOUBLE + (p_partkey * 37 % 1000)::DOUBLE * 0.0001::DOUBLE AS x, 13.0::DOUBLE + (p_partkey * 53 % 1000)::DOUBLE * 0.0001::DOUBLE AS y,
        0.0001::DOUBLE + (p_partkey % 7)::DOUBLE * 0.0001::DOUBLE AS w, 0.0001::DOUBLE + (p_partkey % 5)::DOUBLE * 0.0001::DOUBLE AS h FROM part
), edges AS (
    SELECT layer, x AS ax, y AS ay, x + w AS bx, y + h AS by_ FROM shapes WHERE layer = 'roads'
    UNION ALL SELECT layer, x, y, x + w, y FROM shapes WHERE layer <> 'roads' UNION ALL SELECT layer, x + w, y, x + w, y + h FROM shapes WHERE layer <> 'roads'
    UNION ALL SELECT layer, x + w, y + h, x, y + h FROM shapes WHERE layer <> 'roads' UNION ALL SELECT layer, x, y + h, x, y FROM shapes WHERE layer <> 'roads'
), spots AS (
    SELECT c_custkey AS point_id, 80.1::DOUBLE + (c_custkey * 71 % 1009)::DOUBLE * 0.0001::DOUBLE + 0.00003::DOUBLE AS px,
        13.0::DOUBLE + (c_custkey * 89 % 1013)::DOUBLE * 0.0001::DOUBLE + 0.00004::DOUBLE AS py FROM customer
), along AS (
    SELECT point_id, layer, px, py, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM spots, edges
), parts AS (
    SELECT point_id, layer, px, py, ax, ay, dx, dy, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM along
), nearest AS (
    SELECT point_id, layer, sqrt(min((ax + t * dx - px) * (ax + t * dx - px) + (ay + t * dy - py) * (ay + t * dy - py))) AS edge FROM parts GROUP BY ALL
), inside AS (
    SELECT DISTINCT point_id, layer FROM spots, shapes WHERE layer <> 'roads' AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h
), distances AS (
    SELECT n.point_id, n.layer, CASE WHEN i.point_id IS NULL THEN edge ELSE 0 END AS distance FROM nearest n LEFT JOIN inside i USING (point_id, layer)
)"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as building polygons in metres on the cells' ground."""
    k = F.col("p_partkey")
    x, y = 400000.0 + k * 37 % 10000, 1440000.0 + k * 53 % 10000
    w, h = x + 5.0 + k % 20, y + 8.0 + k % 15
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, sf_dir, "part").select(k.alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array(F.array(v(x, y), v(w, y), v(w, h), v(x, h), v(x, y))).alias("parts"))


BUILDINGS = """buildings AS (
    SELECT p_partkey AS feature_id, 400000.0::DOUBLE + p_partkey * 37 % 10000 AS lo_x, 1440000.0::DOUBLE + p_partkey * 53 % 10000 AS lo_y,
        lo_x + 5.0::DOUBLE + p_partkey % 20 AS hi_x, lo_y + 8.0::DOUBLE + p_partkey % 15 AS hi_y FROM part
)"""


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each run of 50 customers, as wide as their number asks."""
    own = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("k")).count()
    x, y = box_corner(F.col("k"))
    w = 0.01 + F.col("count") * 0.0004
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return own.select(F.concat(F.lit("r"), F.col("k")).alias("run_id"), F.array(v(x, y), v(x + w, y), v(x + w, y + 0.02), v(x, y + 0.02), v(x, y)).alias("ring"))


def box_corner(k: Column) -> tuple[Column, Column]:
    """Lower left corner of a run's box."""
    return 80.0 + (k % 100) * 0.5, 13.0 + (F.floor(k / 100) % 100) * 0.25


BOUNDARY = """boundary AS (
    SELECT 'r' || k AS run_id, 80.0::DOUBLE + (k % 100) * 0.5::DOUBLE AS x0, 13.0::DOUBLE + (k // 100 % 100) * 0.25::DOUBLE AS y0,
        x0 + (0.01::DOUBLE + count(*) * 0.0004::DOUBLE) AS x1, y0 + 0.02::DOUBLE AS y1
    FROM (SELECT c_custkey // 50 AS k FROM customer) GROUP BY k
)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a scene catalogue; every 11th scene has no cloud cover."""
    own = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return own.select(
        F.concat(F.lit("sc_"), F.lpad(k.cast("string"), 9, "0")).alias("scene_id"), F.col("event_type").alias("collection"), F.col("ts").alias("capture_ts"),
        F.when(k % 11 != 0, F.col("value")).alias("cloud_cover"),
        (k % 50).cast("double").alias("lo_x"), (k % 40).cast("double").alias("lo_y"), (k % 50 + 3).cast("double").alias("hi_x"), (k % 40 + 2).cast("double").alias("hi_y"),
    )


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as asks for scenes: a first attempt with low cloud cover in the first days, a second one wider."""
    users = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    u = F.col("user_id")
    box = [(u % 50).cast("double").alias("lo_x"), (u % 40).cast("double").alias("lo_y"), (u % 50 + 1).cast("double").alias("hi_x"), (u % 40 + 1).cast("double").alias("hi_y")]
    start = F.lit("2024-01-01").cast("timestamp")
    one = users.select(u.alias("ask_id"), F.lit(1).alias("attempt"), F.col("event_type").alias("collection"), *box, start.alias("from_ts"), F.lit("2024-01-03").cast("timestamp").alias("to_ts"), F.lit(5.0).alias("max_cloud"))
    two = users.select(u.alias("ask_id"), F.lit(2).alias("attempt"), F.col("event_type").alias("collection"), *box, start.alias("from_ts"), F.lit("2024-03-01").cast("timestamp").alias("to_ts"), F.lit(40.0).alias("max_cloud"))
    return one.unionByName(two)


SCENES = """scenes AS (
    SELECT 'sc_' || lpad(event_id::VARCHAR, 9, '0') AS scene_id, event_type AS collection, ts AS capture_ts, CASE WHEN event_id % 11 <> 0 THEN value END AS cloud_cover,
        (event_id % 50)::DOUBLE AS lo_x, (event_id % 40)::DOUBLE AS lo_y, (event_id % 50 + 3)::DOUBLE AS hi_x, (event_id % 40 + 2)::DOUBLE AS hi_y FROM events
), users AS (SELECT DISTINCT user_id AS u, event_type AS collection FROM events), asks AS (
    SELECT u AS ask_id, attempt, collection, (u % 50)::DOUBLE AS lo_x, (u % 40)::DOUBLE AS lo_y, (u % 50 + 1)::DOUBLE AS hi_x, (u % 40 + 1)::DOUBLE AS hi_y, to_ts, max_cloud
    FROM users, (VALUES (1, TIMESTAMP '2024-01-03', 5.0), (2, TIMESTAMP '2024-03-01', 40.0)) v(attempt, to_ts, max_cloud)
), matches AS (
    SELECT a.ask_id, a.attempt, s.* FROM scenes s JOIN asks a ON s.collection = a.collection AND s.lo_x <= a.hi_x AND s.hi_x >= a.lo_x AND s.lo_y <= a.hi_y AND s.hi_y >= a.lo_y
    WHERE s.capture_ts >= TIMESTAMP '2024-01-01' AND s.capture_ts <= a.to_ts AND coalesce(s.cloud_cover, 100) < a.max_cloud
), found AS (SELECT * FROM matches QUALIFY attempt = min(attempt) OVER (PARTITION BY ask_id))"""


def weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one JSON document a user: {parameter: {day: value}}, the mean value of the user's day."""
    from emberlattice.sources.catalogue import WEATHER

    names = F.array(*map(F.lit, WEATHER))
    own = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("day"), "event_id")
    daily = own.groupBy("user_id", "day").agg(F.max("event_id").alias("v"))
    filled = daily.withColumn("p", F.element_at(names, (F.col("v") % 8 + 1).cast("int")))
    days = filled.groupBy("user_id", "p").agg(F.map_from_entries(F.collect_list(F.struct("day", (F.col("v") / 10.0).alias("x")))).alias("days"))
    return days.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p", "days")))).alias("json"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only table of metadata records."""
    own = table(spark, sf_dir, "events")
    return own.select(F.concat(F.lit("ds_"), F.col("user_id")).alias("dataset_name"), F.col("ts").alias("download_time"), "event_id", F.col("event_type").alias("status"), F.round("value", 2).alias("size"))
