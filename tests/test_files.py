"""Files in and out, settings, the command line, and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli, schema
from strandline.config import Config, load_config
from strandline.plans import extraction
from strandline.sources import geojson, las, obj
from strandline.streaming import tiles


def test_las_round_trip(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    rows = [(i, i * 0.25, -i * 0.5, 3.0 + i * 0.001, 1 + i % 2) for i in range(500)]
    spark.createDataFrame(rows, schema.POINTS).repartition(3).write.format("las").mode("overwrite").save(str(tmp_path / "cloud"))
    found = las.load_points(spark, str(tmp_path / "cloud"))
    assert found.select("point_id").distinct().count() == 500
    got = sorted((round(r["x"], 4), round(r["y"], 4), round(r["z"], 4), r["class"]) for r in found.collect())
    assert got == sorted((round(r[1], 4), round(r[2], 4), round(r[3], 4), r[4]) for r in rows)
    assert found.filter("class = 1").count() == 250
    assert las.las_files(str(tmp_path / "nowhere")) == []


def test_las_headers():
    raw = las.encode(np.array([1.0]), np.array([2.0]), np.array([3.0]), np.array([2]))
    h = las.read_header(raw[:375])
    assert (h.count, h.fmt, h.size, h.offset) == (1, 0, 20, 227)
    assert las.decode_records(raw[h.offset :], h)["class"].tolist() == [2]
    with pytest.raises(ValueError):
        las.read_header(b"nope" + bytes(400))
    packed = bytearray(raw)
    packed[104] |= 0x80
    with pytest.raises(ValueError, match="compressed"):
        las.read_header(bytes(packed))


COLLECTION = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "id": 7, "geometry": {"type": "LineString", "coordinates": [[0, 0, 1], [1, 0, 1], [2, 0, 1]]}, "properties": {}},
        {"type": "Feature", "id": "chain_1", "geometry": {"type": "LineString", "coordinates": [[0, 0, 1], [1, 0, 1]]}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[5, 5], [6, 5]]}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[5, 5]]}},
        {"type": "Feature", "geometry": None},
        {"type": "Other", "geometry": {"type": "Point", "coordinates": [1, 2, 3]}},
        {"type": "Feature", "bbox": [0, 0, 0, 2, 2, 2], "geometry": {"type": "Point", "coordinates": [1, 1, 1]}},
        {"type": "Feature", "bbox": [0, 0, 2, 2], "geometry": {"type": "Point", "coordinates": [4, 4]}},
    ],
}


def test_geojson_reads_what_counts(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(COLLECTION))
    features = geojson.read_geojson(spark, str(tmp_path / "a.geojson"))
    pipes = geojson.pipes_of(features).orderBy("pos").collect()
    assert [(p["pos"], p["x0"], p["x1"]) for p in pipes] == [(0, 0.0, 1.0), (2, 5.0, 6.0)] and np.isnan(pipes[1]["z0"])
    assert geojson.edges_of(features).count() == 3
    comps = geojson.components_of(features).orderBy("pos").collect()
    assert comps[0]["max_x"] == 2.0 and comps[1]["min_x"] == 4.0 and np.isnan(comps[1]["cz"])
    bad = spark.createDataFrame([(json.dumps({"features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1]}}]}),), (json.dumps({"features": None}),)], "value string")
    with pytest.raises(Exception, match="unsupported number of coordinates"):
        geojson.components_of(geojson.parse_collections(bad)).collect()


def test_geojson_is_json(spark, tmp_path):
    pipes = spark.createDataFrame([(9, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (3, 5.0, 0.0, 0.0, 6.0, 1.0, 1.0)], schema.PIPES)
    assert geojson.write_geojson(pipes, None, None, 'x "y"', str(tmp_path / "g"), 25832)
    text = next((tmp_path / "g").glob("part-*")).read_text()
    read = json.loads(text)
    assert read["name"] == 'x "y"' and [f["id"] for f in read["features"]] == ["pipe_0", "pipe_1"] and read["features"][0]["geometry"]["coordinates"][0][0] == 5.0
    assert not geojson.write_geojson(None, None, None, "x", str(tmp_path / "h"))


def test_obj_files(spark, tmp_path):
    pipes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], schema.PIPES)
    obj.write_lines(obj.union_lines(obj.segment_lines(pipes, "pipe_id"), obj.slice_segment_lines(pipes.withColumns({"slice_id": F.lit(4), "seg_id": F.col("pipe_id")}), 4, 0.5)), str(tmp_path / "o"))
    lines = next((tmp_path / "o").glob("part-*")).read_text().splitlines()
    assert lines[:4] == ["# lines: 1", "v 0.000000 0.000000 0.000000", "v 1.000000 1.000000 1.000000", "l 1 2"] and lines[4] == "# slice 4"


def test_settings(spark, tmp_path):
    assert load_config(spark) == Config()
    (tmp_path / "c.json").write_text(json.dumps({"slice_thickness": 0.5, "hough": {"threshold": 3}, "parallel_worker": 2, "odd": 1}))
    with pytest.warns(UserWarning, match="odd"):
        c = load_config(spark, str(tmp_path / "c.json"))
    assert c.slice_thickness == 0.5 and c.hough.threshold == 3 and c.hough.cell_size == 0.01
    with pytest.raises(RuntimeError):
        load_config(spark, str(tmp_path / "none.json"))


def test_schema_check(spark):
    with pytest.raises(ValueError, match="class"):
        schema.require(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point_id bigint, x double, y double, z double"), schema.POINTS, "points")


def _cloud(path, spark):
    """Two planted pipes with a fitting on each."""
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for (ax, ay, ux, uy, z) in ((0.0, 0.0, 1.0, 0.0, 1.0), (0.0, 5.0, 0.6, 0.8, 2.02)):
        for t in np.linspace(0, 8, 5000):
            off = rng.normal(0, 0.015)
            rows.append((i, ax + t * ux - off * uy, ay + t * uy + off * ux, z + float(rng.uniform(-0.04, 0.04)), 1))
            i += 1
        for _ in range(200):
            rows.append((i, ax + 4 * ux + rng.normal(0, 0.05), ay + 4 * uy + rng.normal(0, 0.05), z, 2))
            i += 1
    spark.createDataFrame([tuple(float(v) if 0 < k < 4 else int(v) for k, v in enumerate(r)) for r in rows], schema.POINTS).write.parquet(path)


def test_command_line_finds_planted_pipes(spark, tmp_path, capsys):
    _cloud(str(tmp_path / "cloud.parquet"), spark)
    truth = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0, 1], [8, 0, 1]]}},
            {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 5, 2.02], [4.8, 11.4, 2.02]]}},
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [4, 0, 1]}},
            {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.4, 8.2, 2.02]}},
        ],
    }
    (tmp_path / "gt.geojson").write_text(json.dumps(truth))
    settings = {"point_sample_radius": None, "hough": {"cell_size": 0.05, "canny_sigma": 1.0, "max_line_gap": 1.0}, "slice_cluster_and_merge": {"min_samples": 1}}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    args = ["--input", str(tmp_path / "cloud.parquet"), "--gt_path", str(tmp_path / "gt.geojson"), "--config_path", str(tmp_path / "c.json"), "--output_dir", str(tmp_path / "out"), "--eval"]
    assert cli.main(args, spark) == 0
    metrics = json.loads(next((tmp_path / "out/metrics/cloud_pipes").glob("part-*")).read_text())
    fittings = json.loads(next((tmp_path / "out/metrics/cloud_components").glob("part-*")).read_text())
    assert metrics["missed"] == 0 and metrics["coverage_pct"] > 85 and metrics["xy_median"] < 0.05
    assert fittings["found"] == 2 and fittings["missed"] == 0
    features = geojson.read_geojson(spark, str(tmp_path / "out/geojson/cloud"))
    assert features.filter("id like 'pipe_%'").count() >= 2 and features.filter("id like 'comp_%'").count() >= 2


def test_las_through_sparks_readers_and_replaced_on_commit(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    folder = str(tmp_path / "clouds")
    rows = spark.createDataFrame([(k, float(k), 0.5, -1.25, k % 3) for k in range(100)], schema.POINTS)
    rows.repartition(3).write.format("las").mode("overwrite").save(folder)
    one, two = las.load_points(spark, folder), las.load_points(spark, f"file://{folder}")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and two.count() == 100
    bad = rows.withColumn("x", F.when(F.col("point_id") == 99, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception):  # noqa: B017
        bad.repartition(3).write.format("las").mode("overwrite").save(folder)
    assert las.load_points(spark, folder).count() == 100  # a failed write leaves the old files
    rows.limit(7).coalesce(1).write.format("las").mode("overwrite").save(folder)
    assert las.load_points(spark, folder).count() == 7


def test_default_settings_find_planted_pipes(spark, tmp_path):
    """The surfaces of two pipes and a fitting on each, without a settings file."""
    rng = np.random.default_rng(5)
    rows = []
    for ax, ay, ux, uy, z in ((0.0, 0.0, 1.0, 0.0, 1.0), (0.0, 3.0, 0.6, 0.8, 1.7)):
        t, turn = rng.uniform(0, 6, 15_000), rng.uniform(0, 2 * np.pi, 15_000)
        off, up = 0.1 * np.cos(turn), 0.1 * np.sin(turn)
        rows.append(np.stack([ax + t * ux - off * uy, ay + t * uy + off * ux, z + up, np.ones(15_000)], axis=1))
        at = rng.normal(0, 0.08, (600, 3))
        rows.append(np.stack([ax + 3 * ux + at[:, 0], ay + 3 * uy + at[:, 1], z + at[:, 2], np.full(600, 2.0)], axis=1))
    cloud = [(k, x, y, z, int(c)) for k, (x, y, z, c) in enumerate(np.concatenate(rows).tolist())]
    spark.createDataFrame(cloud, schema.POINTS).write.parquet(str(tmp_path / "cloud.parquet"))
    line = lambda *c: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": c}}
    point = lambda *c: {"type": "Feature", "geometry": {"type": "Point", "coordinates": c}}
    truth = [line([0, 0, 1], [6, 0, 1]), line([0, 3, 1.7], [3.6, 7.8, 1.7]), point(3, 0, 1), point(1.8, 5.4, 1.7)]
    (tmp_path / "gt.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": truth}))
    found = extraction.extract_features(spark, str(tmp_path / "cloud.parquet"), str(tmp_path / "out"), truth=str(tmp_path / "gt.geojson"), evaluate=True)
    pipes, fittings = found["pipe_report"].first(), found["component_report"].first()
    assert pipes["missed"] == 0 and pipes["coverage_pct"] > 85 and pipes["xy_median"] < 0.15
    assert fittings["found"] == 2


def test_empty_cloud_gives_empty_features(spark, tmp_path):
    schema.empty(spark, schema.POINTS).write.parquet(str(tmp_path / "none.parquet"))
    found = extraction.extract_features(spark, str(tmp_path / "none.parquet"), str(tmp_path / "out"))
    assert all(df.count() == 0 for df in found.values())


def test_clean_output(spark, tmp_path):
    schema.empty(spark, schema.POINTS).write.parquet(str(tmp_path / "none.parquet"))
    for name in ("obj/old", "geojson/old", "kept"):
        (tmp_path / "out" / name).mkdir(parents=True)
    args = ["--input", str(tmp_path / "none.parquet"), "--output_dir", str(tmp_path / "out")]
    assert cli.main(args, spark) == 0 and (tmp_path / "out/obj/old").exists()
    assert cli.main([*args, "--clean"], spark) == 0
    assert not (tmp_path / "out/obj/old").exists() and not (tmp_path / "out/geojson/old").exists() and (tmp_path / "out/kept").exists()


def test_stream_of_tiles(spark, tmp_path):
    folder = str(tmp_path / "tiles")
    for k in range(2):
        spark.createDataFrame([(k * 10 + i, 0.1 * i, 0.2, 0.1, 1) for i in range(5)], schema.POINTS).coalesce(1).write.mode("append").parquet(folder)
    query = tiles.running_cells(tiles.read_tiles(spark, folder), 0.2, 1.0).writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("cells").agg(F.sum("n")).first()[0] == 10
    done = tiles.each_tile(tiles.read_tiles(spark, folder), lambda df: df.groupBy("class").count(), str(tmp_path / "out"), str(tmp_path / "state"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 10


def test_cluster_json_of_every_band(spark):
    from strandline.sources import obj

    rows = [(k, k % 4, float(k), 0.5, None if k % 3 else 1.0, float(k + 1), 2.0, 1.0, None if k % 5 == 0 or k % 4 == 3 else k % 2) for k in range(40)]
    cloud = spark.createDataFrame(rows, "seg_id bigint, slice_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, cluster_id bigint")
    bands = {r["slice_id"]: r["value"] for r in obj.cluster_json_bands(cloud, 0.25).collect()}
    assert bands == {k: obj.cluster_json(cloud, k, 0.25).first()["value"] for k in range(4)}
