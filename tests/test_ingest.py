"""The ingest job: what fails for itself, what stops the run, records over two runs; and the order in which stages look for their input."""

import json

import pytest

from emberlattice.plans import jobs
from emberlattice.sources import files as X


def square(x, y, w=0.01):
    return {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]}, "properties": {}}


def land(folder, name, features):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def test_two_runs(spark, tmp_path):
    folder, out = tmp_path / "landed", str(tmp_path / "out")
    land(folder, "boundary", [square(80.2, 13.0, 0.05)])
    land(folder, "water", [square(80.21, 13.01), square(80.23, 13.01)])
    land(folder, "parks", [square(80.21, 13.02)] * 2)
    land(folder, "roads", [])
    (folder / "weather.json").write_text(json.dumps({"T2M": {"20240101": 28.0, "20240102": 29.5}}))
    header = [("s", 80.2, 13.05, 0.01, 0.01, 2, 3, 1)]
    spark.createDataFrame(header, "scene_id string, left double, top double, res_x double, res_y double, width int, height int, bands int").write.parquet(str(folder / "elevation/headers.parquet"))
    spark.createDataFrame([("s", 1, r, c, 1.0) for r in range(3) for c in range(2)][:5], "scene_id string, band int, row int, col int, value double").write.parquet(str(folder / "elevation/pixels.parquet"))
    first = jobs.run_ingest(spark, jobs.landed_sources(str(folder)), out, "city", "2024-01-01")
    assert first["status"] == "COMPLETED_WITH_ERRORS" and first["validation"]["status"] == "PASSED_WITH_WARNINGS"
    assert [e.split(":")[0] for e in first["errors"]] == ["roads", "buildings", "elevation", "cover"] and set(first["tables"]) == {"boundary", "water", "parks", "weather"}
    report = {r.name: (r.status, r.issues or "", r.rows) for r in spark.read.schema("name string, status string, issues string, rows long").json(first["report"]).collect()}
    assert report["water"] == ("PASSED", "", 2) and report["parks"] == ("WARNING", "duplicate_geometries", 2) and report["roads"][0] == report["cover"][0] == "FAILED"
    assert report["weather"] == ("PASSED", "", 2) and report["elevation"] == ("FAILED", "incomplete", 5)
    land(folder, "roads", [square(80.3, 13.3)])
    land(folder, "water", [square(80.21, 13.01)])
    sources = [s for s in jobs.landed_sources(str(folder)) if s.name in ("boundary", "water", "roads")]
    second = jobs.run_ingest(spark, sources, out, "city", "2024-02-01")
    assert second["status"] == "SUCCESS" and second["errors"] == [] and second["validation"]["status"] == "PASSED"
    records = {r.dataset_name: (r.download_time, r.record) for r in jobs.latest_records(spark, out).collect()}
    assert records["water"][0] == "2024-02-01" and records["parks"][0] == "2024-01-01" and len(records) == 8
    water = records["water"][1]
    assert len(water) == 13 and water["bounding_box"] == "80.210000,13.010000,80.220000,13.020000" and len(water["checksum"]) == 64 and int(water["file_size_bytes"]) > 0
    assert records["cover"][1]["checksum"] == "N/A" and records["cover"][1]["status"] == "FAILED"
    assert spark.read.parquet(second["tables"]["water"]).count() == 1


def test_no_boundary_stops_the_run(spark, tmp_path):
    with pytest.raises(RuntimeError, match="boundary"):
        jobs.run_ingest(spark, jobs.landed_sources(str(tmp_path / "nothing")), str(tmp_path / "out"), "city", "2024-01-01")
    land(tmp_path / "empty", "boundary", [])
    with pytest.raises(RuntimeError, match="boundary"):
        jobs.run_ingest(spark, jobs.landed_sources(str(tmp_path / "empty")), str(tmp_path / "out"), "city", "2024-01-01")


def test_stages_look_in_order():
    paths = X.stage_candidates("scores", "o", "b", "p", own="mine")
    assert paths == ["mine", "o/module_1_stage5_pct.parquet", "b/module_1_stage5_pct.parquet", "b/module_1_stage5_labeled.parquet", "p/features.geoparquet", "p/features.parquet"]
    assert all(X.stage_candidates(s, "o", "b", "p")[-1] == "p/features.parquet" for s in X.STAGE_INPUTS)
