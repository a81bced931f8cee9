"""Feature collections read by many tasks equal those that one reader takes whole."""

import json

import numpy as np
import pytest

from emberlattice.sources import files as X
from emberlattice.sources.collections import feature_texts

SPLIT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(params=[97, 1000, 1 << 27])
def stretch(spark, request):
    """Tasks read stretches of so many bytes."""
    before = {k: spark.conf.get(k) for k in SPLIT}
    for k in SPLIT:
        spark.conf.set(k, str(request.param))
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_features(n):
    """Features with braces, brackets, quotes and backslashes in their strings, nested objects, and lists of them."""
    rng = np.random.default_rng(4)
    texts = ['}{', '"}', "\\", '\\"{[', "}]}", "名前{é}", "", "[{", "\n}", "a" * 150 + "{"]
    for i in range(n):
        corner = rng.random(2)
        kind = ("Point", "LineString", "Polygon", None)[i % 4]
        ring = [[float(v) for v in corner + d] for d in ((0, 0), (1, 0), (1, 1), (0, 0))]
        shape = {"type": kind, "coordinates": {"Point": ring[0], "LineString": ring[:2], "Polygon": [ring]}.get(kind)}
        tags = {"id": str(i), "name": texts[i % len(texts)], texts[(i * 3 + 1) % len(texts)] + "k": "v"}
        yield {"type": "Feature", "properties": tags, "geometry": shape if kind else None}


def collection(features, **more):
    return {"crs": {"type": "name", "properties": {"name": "a}{[", "list": [{"b": 1}]}}, "type": "FeatureCollection", "features": features, "bbox": [0, 1, 2, 3], **more}


@pytest.mark.parametrize("indent, ascii_only", [(None, True), (1, False)])
def test_every_feature_once_and_whole(spark, tmp_path, stretch, indent, ascii_only):
    own = list(odd_features(60))
    (tmp_path / "a.geojson").write_text(json.dumps(collection(own, after={"list": [{"c": [{}]}]}), indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    (tmp_path / "b.geojson").write_text(json.dumps(collection(own[:3]), indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    found = feature_texts(spark, str(tmp_path)).collect()
    got = {(r["path"].rsplit("/", 1)[1], r["n"]): json.loads(r["text"]) for r in found}
    assert len(found) == len(got) == 63
    assert got == {**{("a.geojson", i): f for i, f in enumerate(own)}, **{("b.geojson", i): f for i, f in enumerate(own[:3])}}
    table = {r["feature_id"]: r for r in X.read_geojson(spark, str(tmp_path / "a.geojson")).collect()}
    assert all(table[i]["tags"] == f["properties"] for i, f in enumerate(own)) and len(table) == 60
    assert [len(table[i]["parts"]) for i in range(4)] == [1, 1, 1, 0] and table[3]["geom_type"] is None


def test_empty_and_broken_files(spark, tmp_path, stretch):
    for name, text in {"none": "", "blank": "\n", "no features": json.dumps(collection([])), "object": "{}"}.items():
        (tmp_path / f"{name}.geojson").write_text(text)
        assert feature_texts(spark, str(tmp_path / f"{name}.geojson")).count() == 0
    whole = json.dumps(collection(list(odd_features(20))))
    for at in (len(whole) // 2, len(whole) - 40):
        (tmp_path / "cut.geojson").write_text(whole[:at])
        with pytest.raises(ValueError, match="isn't whole"):
            X.read_geojson(spark, str(tmp_path / "cut.geojson"))
    (tmp_path / "water.geojson").write_text(whole[:500])
    (tmp_path / "parks.geojson").write_text(whole)
    assert {r[0] for r in X.read_layers(spark, str(tmp_path)).select("layer").distinct().collect()} == {"parks"}


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    own = list(odd_features(400))
    (tmp_path / "large.geojson").write_text(json.dumps(collection(own)))
    before = {k: spark.conf.get(k) for k in SPLIT}
    try:
        for k in SPLIT:
            spark.conf.set(k, "5000")
        found = feature_texts(spark, str(tmp_path / "large.geojson"))
        assert found.rdd.getNumPartitions() > 10 and found.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
