"""Plans at size: what is broadcast, and what a task reads."""

import datetime

from pyspark.sql import functions as F

from emberlattice.operators.graph import neighbours
from emberlattice.operators.spatial import regular_grid, touching_count
from emberlattice.functions.expressions import cluster_name
from emberlattice.operators.thermal import all_stages, per_run
from emberlattice.plans.queries import QUERIES, SQL
from emberlattice.sources import catalogue as C
from tests.oracle import compare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_are_not_broadcast(spark):
    """files are small where rows aren't; the sides are dealt by keys."""
    cells = spark.range(100).select(F.lit("r").alias("run_id"), (F.col("id") % 10).cast("int").alias("cx"), (F.col("id") / 10).cast("int").alias("cy"))
    pairs = neighbours(cells)
    assert "Broadcast" not in plan(pairs) and pairs.count() == 684
    v = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    box = F.array(v(0.0, 0.0), v(0.005, 0.0), v(0.005, 0.005), v(0.0, 0.005), v(0.0, 0.0))
    grid = regular_grid(spark.range(2).select(F.col("id").alias("run_id"), box.alias("ring")))
    assert "Broadcast" not in plan(grid) and grid.count() == 72
    shapes = spark.range(3).select(F.col("id").alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array(box).alias("parts"))
    points = spark.range(2).select(F.col("id").alias("point_id"), F.lit(0.001).alias("utm_x_m"), F.lit(0.001).alias("utm_y_m"))
    near = touching_count(points, shapes, 0.01)
    assert "BroadcastHashJoin" not in plan(near) and [r.n for r in near.collect()] == [3, 3]


def test_grid_is_dealt_before_it_is_exploded(spark):
    """one task exploded the points of all runs, as their boxes are few bytes."""
    v = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    box = F.array(v(0.0, 0.0), v(0.02, 0.0), v(0.02, 0.02), v(0.0, 0.02), v(0.0, 0.0))
    grid = regular_grid(spark.range(1).select(F.col("id").alias("run_id"), box.alias("ring")))
    files = grid.inputFiles()
    assert len(files) > 1 and grid.count() == 23 * 23


def test_search_makes_pairs_of_the_attempt_that_counts(spark):
    """null bounds, a second attempt, two collections of one ask; pairs aren't shuffled."""
    scene = "scene_id string, collection string, capture_ts timestamp, cloud_cover double, lo_x double, lo_y double, hi_x double, hi_y double"
    day = lambda n: datetime.datetime(2024, 1, n)
    box = (0.0, 0.0, 12.0, 12.0)
    scenes = spark.createDataFrame([("a", "p", day(1), 9.0, *box), ("b", "p", day(2), 3.0, *box), ("c", "p", day(9), None, *box), ("d", "q", None, 1.0, *box), ("e", "p", day(1), 1.0, 90.0, 90.0, 91.0, 91.0)], scene)
    ask = "ask_id long, attempt int, collection string, lo_x double, lo_y double, hi_x double, hi_y double, from_ts timestamp, to_ts timestamp, max_cloud double"
    near = (8.0, 8.0, 11.0, 11.0)
    asks = spark.createDataFrame([
        (1, 1, "p", *near, day(1), day(3), 5.0), (1, 2, "p", *near, day(1), day(30), 50.0),  # the first attempt finds b
        (2, 1, "p", *near, day(3), day(4), 5.0), (2, 2, "p", *near, day(1), day(3), 50.0),  # the second one finds a and b
        (3, 1, "p", *near, None, None, None), (4, 1, "q", *near, day(1), None, None), (5, 1, "q", *near, None, None, 5.0),
        (6, 1, "q", *near, day(1), day(2), 5.0), (6, 1, "p", *near, day(1), day(3), 5.0),
    ], ask)
    found = C.search(scenes, asks)
    got = sorted((r.ask_id, r.attempt, r.scene_id) for r in found.collect())
    assert got == [(1, 1, "b"), (2, 2, "a"), (2, 2, "b"), (3, 1, "a"), (3, 1, "b"), (3, 1, "c"), (5, 1, "d"), (6, 1, "b")]
    joined = plan(found)
    assert joined.index("SortMergeJoin") < joined.index("Exchange")  # nothing is shuffled after the pairs
    assert sorted((r.ask_id, r.scene_id) for r in C.best_scene(scenes, asks).collect()) == [(1, "b"), (2, "b"), (3, "b"), (5, "d"), (6, "b")]
    assert sorted((r.ask_id, r.scene_id) for r in C.first_scene(scenes, asks).collect()) == [(1, "b"), (2, "a"), (3, "a"), (5, "d"), (6, "b")]


def test_cluster_names_beyond_four_digits(spark, tmp_path):
    """F8: the query stands beside its SQL; the operator's names stay different."""
    orders = spark.range(1_234_500, 1_234_700, 50).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit(1.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    name = "prj_26_cluster_name"
    assert compare(spark, QUERIES[name], SQL[name], str(tmp_path)) == 4
    own = spark.range(12345, 12347).select(cluster_name(F.col("id").cast("int")).alias("v"))
    assert [r.v for r in own.collect()] == ["HOT_12345", "HOT_12346"]


def test_few_runs_are_broadcast(spark):
    """A run's figures reach its rows without all of them meeting in one task."""
    own = spark.range(1000).select(F.floor(F.col("id") / 1000).alias("run_id"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = per_run(own, [F.avg("v").alias("m")])
        assert "Broadcast" in plan(joined) and "SortMergeJoin" not in plan(joined) and joined.filter("m = 499.5").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scored_rows_stay_where_they_are(spark):
    """After the table of hotspots only hot cells are shuffled, once, and figures of a run don't repeat the joins."""
    rows = [("r", f"p{i:03}", i % 20, i // 20, 100.0 * (i % 20), 100.0 * (i // 20), 30.0 + (i % 20 == 4) * 9 + i % 7 / 10, 25.0, 10 if i % 3 else 50, 0.1, 0.1, -0.5, 0.1) for i in range(200)]
    names = "run_id string, point_id string, gx int, gy int, utm_x_m double, utm_y_m double, lst_day_celsius double, lst_night_celsius double, land_cover_code int, ndvi double, ndbi double, ndwi double, building_density double"
    out = all_stages(spark.createDataFrame(rows, names))
    joined = plan(out)
    assert joined.count("SortMergeJoin") == 1 and "Union" in joined and "ShuffledHashJoin" not in joined
    got = {r.point_id: r for r in out.collect()}
    assert len(got) == 200 and {r.temperature_total_pixels for r in got.values()} == {200}
    assert {r.hotspot_id for r in got.values() if r.gx == 4} == {"HOT_0001"} and {r.hotspot_id for r in got.values() if r.gx == 12} == {None}
    assert all((r.hotspot_confidence_score is None) == (r.hotspot_id is None) for r in got.values())


def test_bytes_of_every_double(spark):
    """Numbers below the normal ones, infinities, both zeros and missing ones too."""
    import math
    import struct

    from emberlattice.sources.files import wkb_point, wkb_point_xy

    values = [5e-324, 1e-310, -1e-310, math.inf, -math.inf, 0.0, -0.0, 1.0, -2.5, 80.1009, 2.0**-1022, 1.7976931348623157e308, 0.1 + 0.2]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", wkb_point(F.col("v"), F.lit(1.5)).alias("g")).collect()
    assert all(bytes(r.g) == b"\0\0\0\0\1" + struct.pack(">dd", r.v + 0.0, 1.5) for r in rows[:-1]) and rows[-1].g is None
    x, y = wkb_point_xy(F.col("g"))
    back = spark.createDataFrame([(80.1009, 13.0), (-0.25, 1e-9)], "a double, b double").select("a", "b", wkb_point(F.col("a"), F.col("b")).alias("g")).select("a", "b", x.alias("x"), y.alias("y")).collect()
    assert all((r.a, r.b) == (r.x, r.y) for r in back)


def test_few_folders_are_written_without_a_sort(spark, tmp_path):
    """Rows of more folders than files may be open are written too."""
    from emberlattice.sources import files as X

    path, before = str(tmp_path / "layer"), spark.conf.get(X.OPEN)
    own = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 9).alias("run_id"), F.col("id").alias("v"))
    X.write_folders(own, path)
    store = spark._jsparkSession.sharedState().statusStore()
    plan = [store.executionsList().apply(i).physicalPlanDescription() for i in range(store.executionsList().size())][-1]
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan and spark.conf.get(X.OPEN) == before
    assert sorted(map(tuple, spark.read.parquet(path).select("run_id", "v").collect())) == sorted((f"r{i % 9}", i) for i in range(1000))


def test_scores_are_made_of_narrow_tables(spark):
    """The table of hotspots that scores are read from has no column that no stage reads."""
    import os

    from emberlattice.operators.thermal import HOT_READS

    for name in ("prj_24_score", "prj_25_tier"):
        folders = {os.path.dirname(f) for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "/hotspots-" in f}
        assert folders and all(set(spark.read.parquet(f).columns) == {"run_id", *HOT_READS} for f in folders)


def test_components_are_not_broadcast(spark):
    """components and their runs are joined by keys, however well their files are packed."""
    import re

    from emberlattice.operators.graph import lattice_components

    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsList().size()
    cells = spark.createDataFrame([("r", 3 * i + j, k) for i in range(5) for j in (0, 1) for k in range(3)], "run_id string, cx int, cy int")
    got = {(r.cx, r.cy): r.number for r in lattice_components(cells).collect()}
    assert got == {(3 * i + j, k): i + 1 for i in range(5) for j in (0, 1) for k in range(3)}
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(began, store.executionsList().size())]
    sides = [side for p in plans for side in re.findall(r"BroadcastExchange\nInput \[\d+\]: \[([^\]]*)\]", p)]
    assert any("SortMergeJoin" in p and "component#" in p for p in plans) and not [side for side in sides if "component#" in side]
