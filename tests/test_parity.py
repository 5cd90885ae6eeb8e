"""Blocks of searches, distances, re-ranked retrieval, poses, images, matching and connectors on small hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice.functions import camera
from geolattice.operators import cloud, distances, images, knn, matching, pooling, rerank, solve, streets
from geolattice.operators import localize as pose_pipeline
from geolattice.sources import connectors, datasets, sinks
from geolattice.streaming import frames


def vectors(spark, n, seed=0, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).round(1).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>"), np.array([r[1] for r in rows])


def test_blocks_find_what_one_block_finds(spark):
    df, m = vectors(spark, 150)
    for keep in (True, False):
        one = sorted(knn.cosine_topk(df, df, 7, keep_self=keep).collect())
        many = sorted(knn.cosine_topk(df, df, 7, keep_self=keep, block_rows=5).collect())
        assert [(r.qid, r.gid, r["rank"]) for r in one] == [(r.qid, r.gid, r["rank"]) for r in many] and len(one) == 150 * 7
    assert knn.cosine_topk(df, df.limit(0), 3).collect() == []
    assert len(knn.cosine_topk(df.limit(2), df, 3, block_rows=9).collect()) == 298


def test_no_query_block_beyond_its_bound_reaches_the_driver(spark, monkeypatch):
    df, _ = vectors(spark, 60)
    collected, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    found = knn.cosine_topk(df, df, 3, block_rows=8)
    assert [len(c) for c in collected] == [9]
    assert len(collect(found)) == 180


def test_all_distances_in_blocks(spark):
    df, m = vectors(spark, 40)
    got = {(r.qid, r.gid): r.d for r in distances.pairwise(df.filter("id < 12"), df, block_rows=5).collect()}
    assert len(got) == 480
    for (q, g), d in got.items():
        assert d == pytest.approx(((m[q] - m[g]) ** 2).sum(), abs=1e-9)
    assert distances.pairwise(df.limit(0), df).collect() == []


def test_views_over_a_right_angle_are_infinitely_far_but_may_be_listed(spark):
    turn = lambda deg: [np.cos(np.radians(deg)), 0, np.sin(np.radians(deg)), 0, 1, 0, -np.sin(np.radians(deg)), 0, np.cos(np.radians(deg))]
    rows = [(0, turn(0.0), [0.0, 0.0, 0.0]), (1, turn(30.0), [3.0, 4.0, 0.0]), (2, turn(170.0), [1.0, 0.0, 0.0]), (3, turn(200.0), [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, [float(x) for x in r], c) for i, r, c in rows], "id long, r array<double>, c array<double>")
    d = distances.camera_distances(df.filter("id = 0"), df).filter("qid <> gid")
    assert {r.gid: r.d for r in d.collect()} == {1: 5.0, 2: float("inf"), 3: float("inf")}
    assert [r.gid for r in distances.order_k(d, 2).orderBy("rank").collect()] == [1, 2]


def test_retrieval_may_be_reranked_and_keeps_to_the_gallery(spark):
    df, _ = vectors(spark, 60, seed=3)
    gallery, queries = df.filter("id >= 10"), df.filter("id < 14")
    for flag in (False, True):
        rows = rerank.retrieve(gallery, queries, 3, flag).collect()
        assert len(rows) == 42 and all(r.ref_id >= 10 and r.ref_id != r.query_id for r in rows)
        assert sorted({r.ref_rank for r in rows}) == [0, 1, 2]
    both = [(r.query_id, r.ref_rank, r.ref_id) for r in rerank.retrieve(gallery, queries, 3, True).collect()]
    alone = [(r.qid, r["rank"] - 1, r.gid) for r in rerank.graph_rerank_all(df, df.filter("id = 12"), 3, gallery).collect()]
    assert sorted(x for x in both if x[0] == 12) != [] and len(alone) == 3


def rotation(rng, size):
    return solve._rotation(rng.normal(0, size, 3))


def test_three_points_give_the_pose_among_others():
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(100):
        r, t = rotation(rng, 1), rng.normal(0, 1, 3) + [0, 0, 6]
        world = rng.normal(0, 1, (3, 3))
        c = world @ r.T + t
        rs, ts = solve.three_point_poses(world[None], (c[:, :2] / c[:, 2:])[None])
        assert len(rs) <= 4 and all(np.allclose(x @ x.T, np.eye(3), atol=1e-9) and np.linalg.det(x) > 0 for x in rs)
        found += any(np.abs(x - r).max() + np.abs(y - t).max() < 1e-4 for x, y in zip(rs, ts, strict=True))
    assert found >= 98


@pytest.mark.parametrize(("n", "wrong"), [(4, 0), (5, 0), (12, 4), (60, 36)])
def test_robust_pose_from_four_points_on(n, wrong):
    k = np.array([[500, 0, 320], [0, 500, 320], [0, 0, 1.0]])
    for seed in range(10):
        rng = np.random.default_rng(seed)
        r, t = rotation(rng, 0.3), rng.normal(0, 0.5, 3) + [0, 0, 8]
        world = rng.normal(0, 1.5, (n, 3))
        c = world @ r.T + t
        pixels = (c / c[:, 2:] @ k.T)[:, :2]
        pixels[:wrong] += rng.normal(0, 80, (wrong, 2))
        got = solve.robust_pose(world, pixels, k, seed)
        assert got is not None and np.abs(got[0] - r).max() < 1e-3 and got[2][wrong:].all()
    assert solve.robust_pose(np.zeros((3, 3)), np.zeros((3, 2)), k, 0) is None


def test_straight_pixels_undo_a_lens_and_leave_others(spark):
    k, lens = [500.0, 0, 320, 0, 480, 240, 0, 0, 1], [-0.1, 0.01, 0.001, -0.002, 0.0]
    u, v = 0.3, -0.2
    r2 = u * u + v * v
    radial = 1 + lens[0] * r2 + lens[1] * r2 * r2
    x, y = u * radial + 2 * lens[2] * u * v + lens[3] * (r2 + 2 * u * u), v * radial + lens[2] * (r2 + 2 * v * v) + 2 * lens[3] * u * v
    rows = [(500 * x + 320, 480 * y + 240, [float(a) for a in k], lens), (7.0, 8.0, [float(a) for a in k], None)]
    df = spark.createDataFrame(rows, "x double, y double, k array<double>, d array<double>")
    got = [r.p for r in df.select(solve.straight_pixels(F.col("x"), F.col("y"), F.col("k"), F.col("d")).alias("p")).collect()]
    assert (got[0].x, got[0].y) == pytest.approx((500 * u + 320, 480 * v + 240), abs=1e-6) and tuple(got[1]) == (7.0, 8.0)


def test_configuration_names_are_checked():
    c = pose_pipeline.Config.of(k=3, policy="expansion2", verbose=True)
    assert c.policy is pose_pipeline.Policy.EXPANSION2 and c.k == 3
    with pytest.raises(TypeError):
        pose_pipeline.Config.of(radius=3)
    with pytest.raises(KeyError):
        pose_pipeline.Config.of(policy="none")


def test_two_view_points_lie_on_their_rays(spark):
    rng = np.random.default_rng(5)
    world = rng.normal(0, 2, (30, 3)) + [0, 0, 9]
    r, t = rotation(rng, 0.1), np.array([-1.0, 0.1, 0.0])
    a, c = world[:, :2] / world[:, 2:], world @ r.T + t
    b = c[:, :2] / c[:, 2:]
    rows = [(1, 0, i, *a[i].tolist(), *b[i].tolist(), r.reshape(-1).tolist(), t.tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id long, ref_rank long, kp_idx long, ax double, ay double, bx double, by double, r array<double>, t array<double>")
    got = solve.query_point_clouds(df, 1000.0).collect()
    assert len(got) == 30
    for p in got:
        seen = r @ np.array([p.x, p.y, p.z]) + t
        np.testing.assert_allclose(seen[:2] / seen[2], b[p.kp_idx], atol=1e-6)
    assert solve.query_point_clouds(df.limit(5), 1000.0).collect() == []


def test_near_enough_to_either_camera(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, [0.0, 0.0, 0.0], [0.0, 0.0, 9.0]), (0.0, 0.0, 50.0, [0.0, 0.0, 0.0], [0.0, 0.0, 9.0])], "x double, y double, z double, c1 array<double>, c2 array<double>")
    assert cloud.near_enough(df, 5.0).count() == 1


def test_cameras_are_assembled_from_metadata(spark):
    e = [float(x) for x in (1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1)]
    df = spark.createDataFrame([(640, 480, 90.0, None, e, None), (640, 480, None, [9.0] * 9, None, [0.1] * 5)], "w int, h int, fov double, K array<double>, E array<double>, d array<double>")
    got = [r.c for r in df.select(camera.assembled(*[F.col(c) for c in ("w", "h", "fov", "K", "E", "d")]).alias("c")).collect()]
    assert got[0].K[0] == pytest.approx(320) and got[0].T == [5, 6, 7] and got[0].R[0] == 1
    assert got[1].K == [9.0] * 9 and got[1].R is None and got[1].dist == [0.1] * 5
    assert spark.range(1).select(camera.homogeneous(F.array(F.lit(2.0), F.lit(3.0))).alias("x")).first().x == [2.0, 3.0, 1.0]


def test_netvlad_initialisation(spark):
    rng = np.random.default_rng(2)
    middle = np.array([[1, 0, 0.0], [0, 1, 0], [0, 0, 1]])
    rows = []
    for image in range(8):
        for cell in range(12):
            v = 3 * middle[(image + cell) % 3] + rng.normal(0, 0.05, 3)
            rows += [(image, cell, channel, float(v[channel])) for channel in range(3)]
    f = spark.createDataFrame(rows, "image long, cell long, channel long, value double")
    table, alpha = pooling.netvlad_init(f, 3, images=6, per_image=9)
    centers = np.zeros((3, 3))
    for r in table.collect():
        centers[r.k, r.channel] = r.value
    assert sorted(centers.argmax(axis=1).tolist()) == [0, 1, 2] and centers.max(axis=1).min() > 0.98
    assert alpha == pytest.approx(np.log(100), rel=0.1)
    assert pooling.netvlad(f, table, alpha).count() == 8 * 9
    assert pooling.aggregation("GeM") is pooling.gem
    with pytest.raises(KeyError):
        pooling.aggregation("unknown")


def decode(raw):
    return np.frombuffer(raw, dtype=np.uint8).reshape(4, 6, 3)


def means(batch):
    assert len(batch) <= 2
    return batch.mean(axis=(2, 3))


def test_images_through_injected_decoder_and_model(spark):
    rng = np.random.default_rng(3)
    arrays = {f"e{i}": rng.integers(0, 256, (4, 6, 3), dtype=np.uint8) for i in range(5)}
    rows = [(k, a.tobytes()) for k, a in arrays.items()] + [("bad", b"xx")]
    got = {r.entry_id: r for r in images.describe(spark.createDataFrame(rows, "entry_id string, image binary"), decode, means, (4, 6), batch=2).collect()}
    for k, a in arrays.items():
        np.testing.assert_allclose(got[k].v, images.standardized(a).mean(axis=(1, 2)), rtol=1e-5)
    assert got["bad"].v is None and "reshape" in got["bad"].error
    flat = np.full((5, 7, 3), 9, np.uint8)
    assert np.allclose(images.resized(flat, 3, 11), 9) and images.resized(flat[..., 0], 2, 2).shape == (2, 2)
    ramp = np.tile(np.arange(8.0), (4, 1))
    np.testing.assert_allclose(images.resized(ramp, 4, 4)[0], [0.5, 2.5, 4.5, 6.5])
    assert images.gray(np.full((1, 1, 3), 255, np.uint8))[0, 0] == pytest.approx(1.0, abs=1e-6)


def test_descriptors_become_mutual_matches(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 3, (6, 16))
    order = [3, 1, 5, 0, 2, 4]
    left = spark.createDataFrame([(7, i, base[i].tolist()) for i in range(6)], "pair long, kp_idx long, desc array<double>")
    right = spark.createDataFrame([(7, j, (base[o] + rng.normal(0, 0.05, 16)).tolist()) for j, o in enumerate(order)], "pair long, kp_idx long, desc array<double>")
    got = matching.match_descriptors(left, right, rounds=10).collect()
    assert {(r.i, r.j) for r in got} == {(o, j) for j, o in enumerate(order)} and all(0.2 < r.confidence <= 1.0001 for r in got)
    plain = right.withColumnRenamed("desc", "pixels")
    again = matching.detect_and_match(left, plain, lambda side: side.withColumnRenamed("pixels", "desc"), rounds=10).collect()
    assert {(r.i, r.j) for r in again} == {(r.i, r.j) for r in got}


def test_experiments_and_entries(spark, tmp_path):
    folder = tmp_path / "exp"
    folder.mkdir()
    gt, est = np.arange(32.0).reshape(2, 4, 4), np.arange(32.0).reshape(2, 4, 4) + 1
    np.save(folder / "gt.npy", gt)
    np.save(folder / "estm.npy", est)
    np.save(folder / "entries.npy", np.array(["b", "a"]))
    rows = {r.entry_id: r for r in datasets.read_experiment_arrays(spark, str(folder)).collect()}
    assert rows["a"].gt == gt[1].reshape(-1).tolist() and rows["b"].est == est[0].reshape(-1).tolist()
    results = spark.createDataFrame([("a", 1.0)], "entry_id string, gt double")
    for name in ("one", "two"):
        sinks.write_experiment(results, str(tmp_path / "out"), name)
    assert datasets.read_experiment(spark, str(tmp_path / "out"), "two").count() == 1 and datasets.read_experiment(spark, str(tmp_path / "out")).count() == 2
    for name in ("x", "y", "empty"):
        (tmp_path / "set" / name).mkdir(parents=True)
    (tmp_path / "set" / "x" / "f").write_text("")
    (tmp_path / "set" / "file").write_text("1")
    entries = datasets.list_entries(spark, str(tmp_path / "set"))
    assert sorted(r.entry_id for r in entries.collect()) == ["empty", "x", "y"]
    asked = spark.createDataFrame([("x",)], "entry_id string")
    assert sorted(r.entry_id for r in datasets.reference_entries(entries, asked).collect()) == ["empty", "y"]
    assert datasets.reference_entries(entries, asked, asked).count() == 1


def snap(entry, heading, fov, size):
    if entry == "b" and heading == 90:
        raise OSError("gone")
    return f"{entry}:{heading}:{fov}:{size}".encode()


def test_panoramas_by_heading(spark):
    wanted = connectors.panorama_requests(spark.createDataFrame([("a",), ("b",)], "entry_id string"), 80.0, 4)
    got = {r.target_id: r for r in connectors.fetch_panoramas(wanted, snap).collect()}
    assert set(got) == {"a", "a_90", "a_180", "a_270", "b", "b_90", "b_180", "b_270"}
    assert bytes(got["a_180"].image) == b"a:180:80.0:640" and got["b_90"].image is None and got["b_90"].error == "gone" and got["a"].azn == 0.0
    present = spark.createDataFrame([("a", 90.0)], "entry_id string, azn double")
    again = {r.target_id for r in connectors.fetch_panoramas(wanted, snap, present).collect()}
    assert again == {"a_0", "a_180", "a_270", "b", "b_90", "b_180", "b_270"}


def test_street_graphs_by_place_or_disc(spark, tmp_path):
    seen = []

    def client(**asked):
        seen.append(asked)
        return [(1, 49.84, 24.03), (2, 49.85, 24.03)], [(1, 2)]

    nodes, edges = connectors.fetch_street_graph(spark, "Lviv", client)
    connectors.fetch_street_graph(spark, (49.8, 24.0), client, radius=100.0)
    assert seen == [{"place": "Lviv"}, {"point": (49.8, 24.0), "radius": 100.0}]
    with pytest.raises(ValueError):
        connectors.fetch_street_graph(spark, (49.8, 24.0), client)
    assert streets.nearest_node(nodes, 49.8499, 24.031) == 2 and streets.nearest_node(nodes.limit(0), 1.0, 1.0) is None
    nodes.write.parquet(str(tmp_path / "n"))
    edges.write.parquet(str(tmp_path / "e"))
    n, e = datasets.read_street_graph(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert (n.count(), e.count()) == (2, 1)


def test_frames_up_to_a_length(spark):
    df = spark.createDataFrame([(f"/x/f{i:03d}.jpg",) for i in range(20)], "path string")
    assert sorted(r.frame for r in frames.every_nth_frame(df, 4, 3).collect()) == [0, 4, 8]
    assert frames.every_nth_frame(df, 4).count() == 5
