"""Localisation of query images: retrieve, validate, triangulate, solve. One row per query, with a status."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.functions import camera
from geolattice.operators import cloud, solve, spatial
from geolattice.scratch import staged


class Policy(Enum):
    DISPLACEMENT = "displacement"
    EXPANSION = "expansion"
    EXPANSION2 = "expansion2"


@dataclass(frozen=True)
class Config:
    k: int = 10
    confidence_thr: float = 0.3
    points_distance_thr: float = 50.0
    cameras_distance_thr: float = 30.0
    rerank: bool = False
    policy: Policy = Policy.DISPLACEMENT
    verbose: bool = field(default=False, compare=False)  # says nothing about results

    @classmethod
    def of(cls, **values) -> Config:
        """From plain values, as in a configuration file; an unknown policy raises KeyError, an unknown name TypeError."""
        if isinstance(values.get("policy"), str):
            values["policy"] = Policy[values["policy"].upper()]
        return cls(**values)


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column, or NULL where a table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def validated(retrieved: DataFrame, cameras: DataFrame, distance: float) -> DataFrame:
    """(query_id, rank, ref_id, K, R, T, dist, c): retrieved cameras of each query's largest cluster, ranked anew from 0."""
    placed = retrieved.join(cameras.withColumn("dist", _optional(cameras, "dist", "array<double>")), "ref_id").withColumn("c", camera.column(camera.camera_center(F.col("R"), F.col("T"))))
    placed = staged(placed, "retrieved-cameras")
    points = placed.select("query_id", F.col("ref_rank").alias("i"), *[F.get("c", n).alias(a) for n, a in enumerate("xyz")])
    kept = spatial.largest_cluster(points, "query_id", distance).withColumnRenamed("i", "ref_rank")
    order = Window.partitionBy("query_id").orderBy("ref_rank")
    return placed.join(kept, ["query_id", "ref_rank"]).withColumn("rank", F.row_number().over(order) - 1).select("query_id", "rank", "ref_id", "K", "R", "T", "dist", "c")


def point_cloud(refs: DataFrame, matches: DataFrame, config: Config) -> DataFrame:
    """(query_id, kp_idx, i, j, conf, x, y, z): points that the policy accepts.

    Pairs at or under the confidence threshold neither give points nor block others, so they
    are dropped before anything is triangulated.
    """
    view = camera.column(camera.projection_matrix(F.col("K"), F.col("R"), F.col("T")))
    free = solve.straight_pixels(F.col("x"), F.col("y"), F.col("K"), F.col("dist"))
    seen = refs.join(matches, ["query_id", "ref_id"]).withColumn("free", free)
    seen = staged(seen.select("query_id", "rank", "kp_idx", "confidence", view.alias("p"), "c", F.array("free.x", "free.y").alias("x")), "observations")
    side = lambda s: seen.select("query_id", "kp_idx", *[F.col(c).alias(c + s) for c in ("rank", "confidence", "p", "c", "x")])
    pairs = side("1").join(side("2"), ["query_id", "kp_idx"]).filter("rank1 < rank2")
    conf = F.col("confidence1") * F.col("confidence2")
    entries = lambda c: [F.get(c, n) for n in range(3)]
    pairs = pairs.withColumn("conf", conf).filter((F.col("conf") > config.confidence_thr) & ~F.isnan("conf") & ~spatial.same_position(entries("c1"), entries("c2")))
    points = solve.triangulate(pairs, ["query_id", "kp_idx", "rank1", "rank2", "conf", "c1", "c2"])
    far = lambda c: F.sqrt(sum(F.pow(F.col(a) - F.get(c, n), 2) for n, a in enumerate("xyz")))
    near = (far("c1") <= config.points_distance_thr) | (far("c2") <= config.points_distance_thr)
    finite = ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    marked = staged(points.select("query_id", "kp_idx", F.col("rank1").alias("i"), F.col("rank2").alias("j"), "conf", "x", "y", "z", (near & finite).alias("ok")), "points")
    accept = cloud.displacement if config.policy is Policy.DISPLACEMENT else cloud.expansion
    taken = accept(marked, config.confidence_thr).drop("conf")
    return marked.join(taken, ["query_id", "kp_idx", "i", "j"])


def two_view_points(refs: DataFrame, matches: DataFrame, pixels: DataFrame, config: Config) -> DataFrame:
    """(query_id, kp_idx, x, y, z): points of a query and each of its references alone.

    A match counts if its confidence exceeds the root of the threshold that products must pass.
    """
    sure = matches.filter((F.col("confidence") > config.confidence_thr**0.5) & ~F.isnan("confidence"))
    free = solve.straight_pixels(F.col("x"), F.col("y"), F.col("K"), F.col("dist"))
    asked = pixels.select("query_id", "kp_idx", "px", "py", F.col("k").alias("qk"))
    seen = refs.join(sure, ["query_id", "ref_id"]).withColumn("free", free).join(asked, ["query_id", "kp_idx"])
    n = lambda value, m, axis: (value - F.get(m, 3 * axis + 2)) / F.get(m, 4 * axis)
    rows = seen.select(
        "query_id",
        F.col("rank").cast("long").alias("ref_rank"),
        F.col("kp_idx").cast("long").alias("kp_idx"),
        n(F.col("px"), F.col("qk"), 0).alias("ax"),
        n(F.col("py"), F.col("qk"), 1).alias("ay"),
        n(F.col("free.x"), F.col("K"), 0).alias("bx"),
        n(F.col("free.y"), F.col("K"), 1).alias("by"),
        F.col("R").alias("r"),
        F.col("T").alias("t"),
    )
    return solve.query_point_clouds(rows, config.points_distance_thr).select("query_id", "kp_idx", "x", "y", "z")


def localize(queries: DataFrame, retrieved: DataFrame, cameras: DataFrame, matches: DataFrame, config: Config) -> DataFrame:
    """(query_id, status, r, t, n_cameras, n_points, n_inliers) for every query.

    Queries are (query_id, K, keypoints array<struct<kp_idx, px, py>>), retrieved (query_id,
    ref_rank, ref_id), cameras (ref_id, K, R, T), matches (query_id, ref_id, kp_idx,
    confidence, x, y) with pixels of the reference. Queries and cameras may have dist, five
    distortion coefficients or NULL: pixels are straightened first, and reprojection errors are
    those of straight pixels. status is "ok", "too few cameras", "too few points" or "no model";
    a query that is not localised has a NULL pose.
    """
    refs = staged(validated(retrieved, cameras, config.cameras_distance_thr), "validated")
    exploded = queries.select("query_id", F.col("K").alias("k"), _optional(queries, "dist", "array<double>").alias("dist_"), F.explode("keypoints").alias("p"))
    free = solve.straight_pixels(F.col("p.px"), F.col("p.py"), F.col("k"), F.col("dist_"))
    pixels = exploded.withColumn("f", free).select("query_id", "k", "p.kp_idx", F.col("f.x").alias("px"), F.col("f.y").alias("py"))
    points = point_cloud(refs, matches, config).select("query_id", "kp_idx", "x", "y", "z")
    if config.policy is Policy.EXPANSION2:
        points = points.unionByName(two_view_points(refs, matches, pixels, config))
    fits = solve.solve_poses(points.join(pixels, ["query_id", "kp_idx"]))
    counts = refs.groupBy("query_id").agg(F.count("*").cast("int").alias("n_cameras"))
    every = queries.select("query_id").join(counts, "query_id", "left").join(fits, "query_id", "left")
    status = F.coalesce("status", F.when(F.coalesce("n_cameras", F.lit(0)) < 2, "too few cameras").otherwise("too few points"))
    return every.select("query_id", status.alias("status"), "r", "t", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_cameras", "n_points", "n_inliers")])
