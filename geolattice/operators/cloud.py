"""Correspondences of reference pairs and the policies that turn them into 3-D points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_confidences(matches: DataFrame) -> DataFrame:
    """(query_id, kp_idx, i, j, conf): for every pair of references i < j of a query, the keypoints both match, with the product of confidences.

    Pairs of references are few per query by retrieval's k; keypoints meet by equality.
    """
    a = matches.select("query_id", "kp_idx", F.col("ref_rank").alias("i"), F.col("confidence").alias("ci"))
    b = matches.select("query_id", "kp_idx", F.col("ref_rank").alias("j"), F.col("confidence").alias("cj"))
    return a.join(b, ["query_id", "kp_idx"]).filter("i < j").select("query_id", "kp_idx", "i", "j", (F.col("ci") * F.col("cj")).alias("conf"))


def displacement(pairs: DataFrame, threshold: float) -> DataFrame:
    """(query_id, kp_idx, i, j, conf): the last accepted pair of each keypoint, best so far.

    Pairs (query_id, kp_idx, i, j, conf, ok) come in the order of (i, j). A pair is taken if its
    confidence exceeds the threshold and all before it, whether or not those were near enough
    (``ok``): a far but confident pair blocks weaker ones, but does not undo an accepted one.
    """
    order = Window.partitionBy("query_id", "kp_idx").orderBy("i", "j")
    best = F.max(F.when(~F.isnan("conf"), F.col("conf"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    taken = pairs.withColumn("bar", F.greatest(F.lit(threshold), F.coalesce(best, F.lit(threshold)))).filter("ok AND NOT isnan(conf) AND conf > bar")
    last = taken.groupBy("query_id", "kp_idx").agg(F.max(F.struct("i", "j", "conf")).alias("p"))
    return last.select("query_id", "kp_idx", "p.i", "p.j", "p.conf")


def expansion(pairs: DataFrame, threshold: float) -> DataFrame:
    """(query_id, kp_idx, i, j, conf): every near enough pair over the threshold."""
    return pairs.filter((F.col("conf") > threshold) & ~F.isnan("conf") & F.col("ok")).select("query_id", "kp_idx", "i", "j", "conf")


def near_enough(points: DataFrame, distance: float) -> DataFrame:
    """Keeps points (x, y, z) within ``distance`` of either camera centre (c1, c2 arrays)."""
    d = lambda c: F.sqrt(F.pow(F.col("x") - F.get(c, 0), 2) + F.pow(F.col("y") - F.get(c, 1), 2) + F.pow(F.col("z") - F.get(c, 2), 2))
    return points.filter((d(F.col("c1")) <= distance) | (d(F.col("c2")) <= distance))
