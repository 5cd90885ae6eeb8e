"""Readers, writers, connectors and streams over files written here."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice.sources import connectors, datasets, sinks
from geolattice.streaming import frames


@pytest.fixture()
def dataset(tmp_path):
    root = tmp_path / "set"
    for i in range(3):
        d = root / f"e{i}"
        d.mkdir(parents=True)
        (d / "metadata.json").write_text(json.dumps({"w": 640, "h": 480, "lat": 1.5 * i, "fov": 90.0, "K": [[1, 0, 2], [0, 1, 3], [0, 0, 1]], "pano": f"p{i}"} | ({"E": np.eye(4).tolist()} if i else {})))
        np.save(d / "net_descriptor.npy", np.arange(4, dtype=np.float32)[None] + i)
        np.savez(d / "keypoints.npz", keypoints=np.array([[1, 2], [3, 4.5]]), scores=np.array([0.5, 0.25]), descriptors=np.ones((3, 2)), image=np.zeros((2, 2)))
        (d / "image.jpg").write_bytes(b"not really an image")
    (root / "e0" / "x.jpg.bak").write_text("x")
    return str(root)


def test_directory_dataset(spark, dataset):
    assert sorted(r.entry_id for r in datasets.list_entries(spark, dataset).collect()) == ["e0", "e1", "e2"]
    m = {r.entry_id: r for r in datasets.read_metadata(spark, dataset).withColumn("pano", F.expr("variant_get(extras, '$.pano', 'string')")).drop("extras").collect()}
    assert (m["e1"].w, m["e1"].lat, m["e1"].pano, m["e1"].azn) == (640, 1.5, "p1", None)
    assert m["e1"].K == [1, 0, 2, 0, 1, 3, 0, 0, 1] and m["e0"].E is None and len(m["e2"].E) == 16
    v = {r.entry_id: r.v for r in datasets.read_descriptors(spark, dataset, "net").collect()}
    assert v["e2"] == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        datasets.read_descriptors(spark, dataset, "")
    k = datasets.read_keypoints(spark, dataset).filter("entry_id = 'e1'").orderBy("kp_idx").collect()
    assert [(r.kp_idx, r.x, r.y, r.score, r.desc) for r in k] == [(0, 1, 2, 0.5, [1, 1, 1]), (1, 3, 4.5, 0.25, [1, 1, 1])]
    assert datasets.read_images(spark, dataset).count() == 3
    assert {r.path for r in datasets.match_paths(spark, dataset, r"e\d/\w+\.jpg").collect()} == {"e0/image.jpg", "e1/image.jpg", "e2/image.jpg", "e0/x.jpg.bak"}


def test_pose_files(spark, tmp_path):
    (tmp_path / "intr.txt").write_text("a.jpg SIMPLE 1001 500 800 500 250 0.1\nb.jpg SIMPLE 400 300 350 200 150 0\n")
    (tmp_path / "extr.nvm").write_text("NVM_V3\n\n2\na.jpg 800 1 0 0 0 1 2 3 0 0\nb.jpg 350 0 0 1 0 4 5 6 0 0\nignored 1 1 0 0 0 0 0 0 0 0\n")
    k = datasets.read_aachen_intrinsics(spark, str(tmp_path / "intr.txt"), 640)
    r = {x.name: x for x in k.collect()}
    assert (r["a.jpg"].w, r["a.jpg"].h) == (640, round(500 * 640 / 1001)) and r["b.jpg"].w == 400
    assert r["a.jpg"].K[0] == pytest.approx(800 * 640 / 1001)
    e = datasets.read_aachen_extrinsics(spark, str(tmp_path / "extr.nvm"))
    p = {x.name: x for x in e.collect()}
    assert set(p) == {"a.jpg", "b.jpg"} and p["a.jpg"].T == [-1, -2, -3]
    np.testing.assert_allclose(p["b.jpg"].R, [-1, 0, 0, 0, 1, 0, 0, 0, -1], atol=1e-12)
    assert datasets.merge_poses(k, e).count() == 2
    with pytest.raises(KeyError):
        datasets.merge_poses(k.filter("name = 'a.jpg'"), e)
    (tmp_path / "cam.txt").write_text("h1\nh2\nh3\nseq1/f.png 1 2 3 1 0 0 0\n")
    c = datasets.read_cambridge_poses(spark, str(tmp_path / "cam.txt")).collect()
    assert [(x.name, x.T) for x in c] == [("seq1/f.png", [-1, -2, -3])]
    sinks.write_submission(e.select(F.regexp_replace("name", r"\.jpg$", "").alias("name"), "R", "T"), str(tmp_path / "sub"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "sub")).collect()]
    assert lines[0].split()[:2] == ["a.jpg", "1.000000000"] and len(lines) == 2


def test_writers_round_trip(spark, dataset, tmp_path):
    d = datasets.read_descriptors(spark, dataset, "net")
    sinks.write_descriptors(d, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).filter("descriptor_type = 'net'").count() == 3
    k = datasets.read_keypoints(spark, dataset)
    sinks.write_keypoints(k, str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == k.count()
    sinks.write_experiment(d.select("entry_id"), str(tmp_path / "x"), "one")
    assert os.path.isdir(tmp_path / "x" / "exp_name=one")
    sinks.write_new(d, str(tmp_path / "n"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_new(d, str(tmp_path / "n"))


def test_connectors_survive_failures(spark):
    def panorama(lat, lng):
        if lat == 3:
            raise OSError("down")
        return {"status": "OK" if lat != 4 else "ZERO_RESULTS", "pano_id": f"p{int(lat) // 2}", "location": {"lat": lat, "lng": lng}}

    coords = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "ord long, lat double, lng double")
    found = connectors.fetch_metadata(coords, panorama)
    assert [r.error for r in found.filter("error IS NOT NULL").collect()] == ["down"]
    assert {(r.pano_id, r.ord) for r in connectors.keep_panoramas(found).collect()} == {("p0", 0), ("p1", 2), ("p2", 5)}

    def heights(points):
        if points[0][0] >= 4:
            raise OSError("down")
        return [10 * lat for lat, _ in points]

    entries = coords.select(F.col("ord").alias("entry_id"), "lat", "lng")
    alt = {r.entry_id: r.alt for r in connectors.fetch_elevations(entries, heights, 2).collect()}
    assert alt == {0: 0, 1: 10, 2: 20, 3: 30, 4: None, 5: None}
    r = connectors.panorama_requests(entries.filter("entry_id = 1"), 90, 4).collect()
    assert sorted(x.target_id for x in r) == ["1", "1_180", "1_270", "1_90"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    for i in range(7):
        (folder / f"f{i:03d}.jpg").write_bytes(b"x" * (i + 1))
    stream = frames.every_nth_frame(frames.frame_stream(spark, str(folder), per_trigger=3), 3)
    q = stream.select("frame").writeStream.format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.frame for r in spark.sql("SELECT * FROM frames_out").collect()) == [0, 3, 6]
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 2.0), ("b", 400, 3.0)], "pano_id string, s long, value double").select("pano_id", F.timestamp_seconds("s").alias("ts"), "value")
    rows.write.parquet(str(tmp_path / "events"))
    read = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    for name, df in (("first_out", frames.first_panoramas(read)), ("win_out", frames.windowed_counts(read, "pano_id"))):
        q = df.writeStream.outputMode("append" if name == "first_out" else "update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT * FROM first_out").count() == 2
    assert {(r.pano_id, r.n) for r in spark.sql("SELECT * FROM win_out").collect()} == {("a", 2), ("b", 1)}
