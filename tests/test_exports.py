"""What the hotspot job's exports leave on disk."""

import os

from pyspark.sql import functions as F

from emberlattice.operators.neighbours import k_nearest
from emberlattice.plans import landed  # noqa: F401  registers its queries
from emberlattice.plans.queries import QUERIES
from emberlattice.scratch import Scratch, interim, shared_folder, written
from emberlattice.sources import files as X

SF = "/root/testdata/sf0.001"


def local(path):
    return path.removeprefix("file://")


def test_exports_leave_one_layer_and_no_tables_of_stages(spark):
    """tables of all stages, a second copy of the layer and unpacked GeoJSON stayed on disk (14 times the input)."""
    folder = local(shared_folder(spark))
    before = set(os.listdir(folder))
    rows = QUERIES["snk_3_layer_parquet"](spark, SF).collect()
    new = sorted(set(os.listdir(folder)) - before)
    assert [n.split("-")[0] for n in new] == ["hotspots", "registry"]
    own = f"{folder}/{new[0]}"
    assert set(os.listdir(own)) == {"knowledge_layer.parquet", "knowledge_layer.geojsonl", "hotspot_registry.parquet", "cluster_validation.json", "metadata.json"}
    lines = [n for n in os.listdir(f"{own}/knowledge_layer.geojsonl") if n.startswith("part-")]
    assert lines and all(n.endswith(".gz") for n in lines)
    back = X.read_geojson_lines(spark, f"file://{own}/knowledge_layer.geojsonl")
    point = F.col("parts")[0][0]
    found = {(r.k, r.h, r.x, r.y) for r in back.select(F.col("tags")["point_id"].alias("k"), F.col("tags")["hotspot_id"].alias("h"), F.round(point["x"], 6).alias("x"), F.round(point["y"], 6).alias("y")).collect()}
    assert len(rows) == 1500 and found == {(r.point_id, r.hotspot_id, r.x, r.y) for r in rows}
    layer = spark.read.parquet(f"file://{own}/knowledge_layer.parquet")
    clusters = spark.read.parquet(f"file://{own}/hotspot_registry.parquet")
    assert layer.count() == 1500 and clusters.agg(F.sum("cluster_size_pixels")).first()[0] == sum(r.hotspot_id is not None for r in rows)
    assert spark.read.json(f"file://{own}/cluster_validation.json").filter("valid").count() == 1


def test_neighbours_keep_answers_only(spark):
    """places and their leaves stayed beside the answers while hotspots were written."""
    folder = local(shared_folder(spark))
    for most, gone in ((1, {"spots", "placed"}), (2, {"spots"})):  # points a place
        points = spark.range(400 * most).selectExpr("'r' as run_id", "id as point_id", f"cast(floor(id / {most}) % 20 as double) * 100 as utm_x_m", f"cast(floor(id / {20 * most}) as double) * 100 as utm_y_m")
        before = set(os.listdir(folder))
        near = k_nearest(points, 3)
        own = next(n for n in set(os.listdir(folder)) - before if n.startswith("neighbours"))
        assert gone == {"spots", "placed"} - set(os.listdir(f"{folder}/{own}"))
        assert near.count() == 3 * 400 * most and near.filter("rank = 1 and d2 > 0").isEmpty()


def test_folders_of_an_interim_go_with_it(spark):
    keeps = Scratch(spark, "keeps")
    with interim(spark):
        outer = Scratch(spark, "outer")
        with interim(spark):
            inner = Scratch(spark, "inner")
            kept = keeps.keep(inner.keep(spark.range(3), "table"), "table")
        assert not os.path.exists(local(inner.folder))
        outer.keep(spark.range(2), "table")
        assert os.path.exists(local(outer.folder))
    assert not os.path.exists(local(outer.folder))
    assert kept.count() == 3 and written(spark.range(4), "after").count() == 4
