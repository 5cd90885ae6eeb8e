"""Registered queries of the numeric kernels, over synthetic scenes with known answers.

Every vector id q is a scene: 24 points, two reference cameras and a query camera, all from
integer formulas, so the oracles state the true points and poses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import camera
from geolattice.operators import knn, rerank, solve
from geolattice.operators import localize as pose_pipeline
from geolattice.scratch import staged

POINTS = 24
FOCAL, MIDDLE = 500.0, 320.0


def _scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, k, world): scene points."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(POINTS - 1).cast("long"))).alias("k"))
    q, k = F.col("q"), F.col("k")
    return e.select("q", "k", F.array((k * 7 + q) % 11 - 5.0, (k * 5 + q * 3) % 9 - 4.0, 10.0 + (k * 3 + q * 2) % 7).alias("world"))


def _k() -> camera.Matrix:
    return camera.Matrix(F.lit(v) for v in (FOCAL, 0.0, MIDDLE, 0.0, FOCAL, MIDDLE, 0.0, 0.0, 1.0))


def _query_rotation() -> camera.Matrix:
    return camera.rotation_y((F.col("q") % 7 - 3).cast("double"))


def _query_center() -> camera.Matrix:
    return camera.Matrix([(F.col("q") % 5) / 5.0, (F.col("q") % 3) / 10.0, -(F.col("q") % 4) / 4.0])


def _project(r, t, world: Column) -> Column:
    h = camera.matmul(camera.projection_matrix(_k(), r, t), [*[F.get(world, i) for i in range(3)], F.lit(1.0)], 3, 4, 1)
    return F.array(h[0] / h[2], h[1] / h[2])


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, k, world, p1, x1, p2, x2, x): projections and pixels of both references, and the query's pixels."""
    one = camera.rotation_y(F.lit(0.0))
    two = camera.rotation_y(F.lit(5.0))
    t1, t2 = [F.lit(0.0)] * 3, camera.translation_from_center(two, [F.lit(1.0), F.lit(0.2), F.lit(0.0)])
    tq = camera.translation_from_center(_query_rotation(), _query_center())
    w = F.col("world")
    return _scene(spark, sf_dir).select(
        "q", "k", "world",
        camera.projection_matrix(_k(), one, t1).alias("p1"), _project(one, t1, w).alias("x1"),
        camera.projection_matrix(_k(), two, t2).alias("p2"), _project(two, t2, w).alias("x2"),
        _project(_query_rotation(), tq, w).alias("x"),
    )


def triangulate_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = solve.triangulate(_views(spark, sf_dir), ["q", "k"])
    return found.select("q", "k", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z")])


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangulated points with the query's pixels, every sixth of them moved far off."""
    v = _views(spark, sf_dir)
    points = solve.triangulate(v, ["q", "k"])
    off = F.when(F.col("k") % 6 == 5, 1.0).otherwise(0.0)
    pixels = v.select("q", "k", (F.get("x", 0) + 40 * off).alias("px"), (F.get("x", 1) - 25 * off).alias("py"))
    return points.join(pixels, ["q", "k"]).select(F.col("q").alias("query_id"), "x", "y", "z", "px", "py", _k().alias("k"))


def solve_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = solve.solve_poses(_observed(spark, sf_dir))
    c = camera.camera_center(F.col("r"), F.col("t"))
    return s.select("query_id", "status", "n_points", "n_inliers", *[(F.round(c[i], 4) + 0.0).alias(f"c{i}") for i in range(3)], (F.round(F.get("r", 2), 4) + 0.0).alias("r02"))


def four_point_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses from four points each, all right; a pose counts as found if all four fit."""
    v = _views(spark, sf_dir).filter("k IN (0, 5, 10, 15)")
    points = solve.triangulate(v, ["q", "k"]).join(v.select("q", "k", F.get("x", 0).alias("px"), F.get("x", 1).alias("py")), ["q", "k"])
    s = solve.solve_poses(points.select(F.col("q").alias("query_id"), "x", "y", "z", "px", "py", _k().alias("k")))
    return s.select("query_id", "status", "n_points", "n_inliers")


def two_view_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose of the second reference relative to the first, up to scale."""
    n = lambda x, i: (F.get(x, i) - MIDDLE) / FOCAL
    v = _views(spark, sf_dir).select(F.col("q").alias("query_id"), F.lit(0).cast("long").alias("ref_rank"), n("x1", 0).alias("ax"), n("x1", 1).alias("ay"), n("x2", 0).alias("bx"), n("x2", 1).alias("by"))
    s = solve.two_view_poses(v)
    return s.select("query_id", "status", "n_inliers", *[(F.round(F.get("t", i), 3) + 0.0).alias(f"t{i}") for i in range(3)], (F.round(F.get("r", 2), 4) + 0.0).alias("r02"))


def undistort_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points bent by a lens model and straightened again."""
    s = _scene(spark, sf_dir).select("q", "k", (F.get("world", 0) / F.get("world", 2)).alias("x"), (F.get("world", 1) / F.get("world", 2)).alias("y"))
    k1, k2, p1, p2, k3 = -0.08, 0.02, 0.001, -0.0015, 0.003
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    bent = s.select("q", "k", (F.col("x") * radial + 2 * p1 * F.col("x") * F.col("y") + p2 * (r2 + 2 * F.col("x") * F.col("x"))).alias("x"), (F.col("y") * radial + p1 * (r2 + 2 * F.col("y") * F.col("y")) + 2 * p2 * F.col("x") * F.col("y")).alias("y"))
    u = solve.undistort(F.col("x"), F.col("y"), F.array(*[F.lit(v) for v in (k1, k2, p1, p2, k3)]))
    return bent.select("q", "k", u.alias("u")).select("q", "k", (F.round("u.x", 6) + 0.0).alias("x"), (F.round("u.y", 6) + 0.0).alias("y"))


QUERIES = {f.__name__: f for f in (triangulate_scenes, solve_poses, four_point_poses, two_view_poses, undistort_points)}

_SCENE = "s AS (SELECT vec_id AS q, k, (k * 7 + vec_id) % 11 - 5e0 AS x, (k * 5 + vec_id * 3) % 9 - 4e0 AS y, 10e0 + (k * 3 + vec_id * 2) % 7 AS z FROM embeddings, range(0, 24) g(k))"

ORACLES = {
    "triangulate_scenes": f"WITH {_SCENE} SELECT q, k, x + 0e0 AS x, y + 0e0 AS y, z FROM s",
    "solve_poses": """SELECT vec_id AS query_id, 'ok' AS status, CAST(24 AS INTEGER) AS n_points, CAST(20 AS INTEGER) AS n_inliers, round((vec_id % 5) / 5e0, 4) AS c0, round((vec_id % 3) / 10e0, 4) AS c1,
round(-(vec_id % 4) / 4e0, 4) + 0e0 AS c2, round(sin(radians(vec_id % 7 - 3e0)), 4) + 0e0 AS r02 FROM embeddings""",
    "four_point_poses": "SELECT vec_id AS query_id, 'ok' AS status, CAST(4 AS INTEGER) AS n_points, CAST(4 AS INTEGER) AS n_inliers FROM embeddings",
    "two_view_poses": """WITH t AS (SELECT radians(5e0) AS a, sqrt(1.04e0) AS n) SELECT vec_id AS query_id, 'ok' AS status, CAST(24 AS INTEGER) AS n_inliers, round(-cos(a) / n, 3) AS t0, round(-0.2e0 / n, 3) AS t1, round(sin(a) / n, 3) AS t2, round(sin(a), 4) AS r02 FROM embeddings, t""",
    "undistort_points": f"WITH {_SCENE} SELECT q, k, round(x / z, 6) + 0e0 AS x, round(y / z, 6) + 0e0 AS y FROM s",
}


# --- end to end -----------------------------------------------------------------------------

EVERY, K_REFS = 50, 6


def _reference_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, K, R, T): every vector as a reference camera a few metres from the scene's origin."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ref_id"))
    v = F.col("ref_id")
    r = camera.rotation_y((v % 9 - 4).cast("double"))
    c = [(v % 5) * 1.0, (v % 3) / 5.0, -(v % 4) / 2.0]
    return e.select("ref_id", _k().alias("K"), r.alias("R"), camera.translation_from_center(r, c).alias("T"))


#: Lens distortion of the bent scenes.
_LENS = (-0.08, 0.02, 0.001, -0.0015, 0.003)


def _bent(x: Column) -> Column:
    """A pixel as a lens with ``_LENS`` shows it."""
    k1, k2, p1, p2, k3 = _LENS
    u, v = (F.get(x, 0) - MIDDLE) / FOCAL, (F.get(x, 1) - MIDDLE) / FOCAL
    r2 = u * u + v * v
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    return F.array(FOCAL * (u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u)) + MIDDLE, FOCAL * (v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v) + MIDDLE)


def _asked(spark: SparkSession, sf_dir: str, config: pose_pipeline.Config, lens: bool = False, wrong: bool = False) -> DataFrame:
    """Every fiftieth vector asks; references are retrieved over all vectors, and see its scene.

    With ``lens`` all pixels are bent; with ``wrong`` every sixth keypoint is matched elsewhere.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    unit = knn.normalized(vectors, "vec_id", "embedding")
    asked = unit.filter(F.col("id") % EVERY == 0)
    retrieved = staged(rerank.retrieve(unit, asked, K_REFS, True) if config.rerank else _retrieved(unit, asked), "retrieved")
    cams = _reference_cameras(spark, sf_dir)
    scene = _scene(spark, sf_dir).filter(F.col("q") % EVERY == 0)
    tq = camera.translation_from_center(_query_rotation(), _query_center())
    shown = _bent if lens else lambda x: x
    pixels = scene.select("q", "k", _project(_query_rotation(), tq, F.col("world")).alias("x")).select("q", "k", shown(F.col("x")).alias("x"))
    queries = pixels.groupBy(F.col("q").alias("query_id")).agg(F.collect_list(F.struct(F.col("k").alias("kp_idx"), F.get("x", 0).alias("px"), F.get("x", 1).alias("py"))).alias("keypoints")).withColumn("K", camera.column(_k()))
    if lens:
        dist = F.array(*[F.lit(v) for v in _LENS])
        queries, cams = queries.withColumn("dist", dist), cams.withColumn("dist", dist)
    seen = retrieved.join(cams, "ref_id").join(scene.withColumnRenamed("k", "kp"), F.col("query_id") == F.col("q"))
    seen = seen.withColumn("x", shown(_project(F.col("R"), F.col("T"), F.col("world"))))
    conf = 0.55 + ((F.col("kp") * 37 + F.col("ref_rank") * 91 + F.col("q") * 53) % 400) / 1000.0
    off = F.when(F.col("kp") % 6 == 5, 1.0 + F.col("ref_rank")).otherwise(0.0) if wrong else F.lit(0.0)
    matches = seen.select("query_id", "ref_id", F.col("kp").alias("kp_idx"), conf.alias("confidence"), (F.get("x", 0) + 35 * off).alias("x"), (F.get("x", 1) - 20 * off).alias("y"))
    return pose_pipeline.localize(queries, retrieved, cams, matches, config)


def _retrieved(unit: DataFrame, asked: DataFrame) -> DataFrame:
    found = knn.cosine_topk(unit, asked, K_REFS)
    return found.select(F.col("qid").alias("query_id"), (F.col("rank") - 1).alias("ref_rank"), F.col("gid").alias("ref_id"))


def _centres(done: DataFrame, *more: str, least: int = 20) -> DataFrame:
    c = camera.camera_center(F.col("r"), F.col("t"))
    return done.select("query_id", "status", "n_cameras", *more, (F.col("n_inliers") >= least).alias("supported"), *[(F.round(c[i], 4) + 0.0).alias(f"c{i}") for i in range(3)])


def localize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centres(_asked(spark, sf_dir, pose_pipeline.Config(k=K_REFS)), "n_points")


def localize_distorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bent pixels on both sides, and four wrong matches of 24; a point on the line of two cameras may be lost too."""
    return _centres(_asked(spark, sf_dir, pose_pipeline.Config(k=K_REFS), lens=True, wrong=True), least=18)


def localize_expansion2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accepted pairs and the two-view points of each reference, over re-ranked references.

    Two-view points are not to scale; those that fit within a pixel by chance move the pose by
    centimetres, so the answer is whether it is within a quarter of a metre of the truth.
    """
    done = _asked(spark, sf_dir, pose_pipeline.Config(k=K_REFS, rerank=True, policy=pose_pipeline.Policy.EXPANSION2))
    c, true = camera.camera_center(F.col("r"), F.col("t")), _query_center()
    q = done.withColumnRenamed("query_id", "q")
    near = sum(F.pow(c[i] - true[i], 2) for i in range(3)) < 0.0625
    return q.select(F.col("q").alias("query_id"), "status", "n_cameras", (F.col("n_inliers") >= 20).alias("supported"), near.alias("near"))


QUERIES |= {f.__name__: f for f in (localize_distorted, localize_expansion2)}
QUERIES["localize"] = localize
ORACLES["localize"] = f"""SELECT vec_id AS query_id, 'ok' AS status, CAST({K_REFS} AS INTEGER) AS n_cameras, CAST(24 AS INTEGER) AS n_points, true AS supported,
round((vec_id % 5) / 5e0, 4) AS c0, round((vec_id % 3) / 10e0, 4) AS c1, round(-(vec_id % 4) / 4e0, 4) + 0e0 AS c2 FROM embeddings WHERE vec_id % {EVERY} = 0"""
ORACLES["localize_distorted"] = ORACLES["localize"].replace("CAST(24 AS INTEGER) AS n_points, ", "")
ORACLES["localize_expansion2"] = f"SELECT vec_id AS query_id, 'ok' AS status, CAST({K_REFS} AS INTEGER) AS n_cameras, true AS supported, true AS near FROM embeddings WHERE vec_id % {EVERY} = 0"
