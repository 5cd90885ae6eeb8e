"""Registered queries of spatial validation, correspondence policies and pose evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators import cloud, metrics, spatial
from geolattice.plans.fixtures import CAMERAS, cameras, matches, sql_matches

THRESHOLD = 0.3


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, i, x, y, z): ten groups of cameras on a grid in metres, with gaps."""
    c = cameras(spark, sf_dir).withColumnRenamed("entry_id", "v")
    return c.select((F.col("v") % 10).alias("g"), F.col("v").alias("i"), ((F.col("v") * 7) % 101 * 3.0).alias("x"), (F.col("alt") - 290).alias("y"), ((F.col("v") * 13) % 89 * 2.0).alias("z"))


_POSITIONS = f"pos AS (SELECT entry_id % 10 AS g, entry_id AS i, (entry_id * 7) % 101 * 3e0 AS x, alt - 290 AS y, (entry_id * 13) % 89 * 2e0 AS z FROM ({CAMERAS}))"
_LINKS = "links AS (SELECT a.g, a.i, b.i AS j FROM pos a JOIN pos b ON a.g = b.g AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) < 30)"
_REACH = "reach AS (SELECT g, i, i AS j FROM pos UNION SELECT r.g, r.i, l.j FROM reach r JOIN links l ON r.g = l.g AND r.j = l.i), comp AS (SELECT g, i, min(j) AS comp FROM reach GROUP BY g, i)"


def proximity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.proximity_links(_positions(spark, sf_dir), "g", 30.0)


def filter_distant_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.largest_cluster(_positions(spark, sf_dir), "g", 30.0)


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir)
    comp = spatial.components(p, spatial.proximity_links(p, "g", 30.0), "g")
    return comp.groupBy("g", "comp").agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("kp_idx") * 5 + F.col("i") * 3 + F.col("j") * 11 + F.col("query_id")) % 10 < 6
    return cloud.pair_confidences(matches(spark, sf_dir)).withColumn("ok", ok)


_PAIRS = f"""{sql_matches()},
pairs AS (SELECT a.query_id, a.kp_idx, a.ref_rank AS i, b.ref_rank AS j, a.confidence * b.confidence AS conf, (a.kp_idx * 5 + a.ref_rank * 3 + b.ref_rank * 11 + a.query_id) % 10 < 6 AS ok
 FROM matches a JOIN matches b ON a.query_id = b.query_id AND a.kp_idx = b.kp_idx AND a.ref_rank < b.ref_rank)"""


def match_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("query_id", "i", "j").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 6).alias("conf"))


def displacement_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud.displacement(_pairs(spark, sf_dir), THRESHOLD).withColumn("conf", F.round("conf", 6))


def expansion_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pairs by query and references: their number, keypoints added up and confidence."""
    taken = cloud.expansion(_pairs(spark, sf_dir), THRESHOLD)
    return taken.groupBy("query_id", "i", "j").agg(F.count("*").alias("n"), F.sum("kp_idx").alias("keypoints"), F.round(F.sum("conf"), 6).alias("conf"))


def min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with at least four points after displacement."""
    return cloud.displacement(_pairs(spark, sf_dir), THRESHOLD).groupBy("query_id").agg(F.count("*").alias("points")).filter("points >= 4")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_orderkey") * 7 % 97 / F.lit(10.0)).alias("t_err"), (F.col("o_orderkey") * 11 % 89 / F.lit(8.0)).alias("r_err"))


_ERRORS = "e AS (SELECT o_orderkey * 7 % 97 / 10e0 AS t_err, o_orderkey * 11 % 89 / 8e0 AS r_err FROM orders)"
THRESHOLDS = ((0.5, 2.0), (1.0, 5.0), (5.0, 10.0))


def accuracy_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_at_thresholds(_errors(spark, sf_dir), THRESHOLDS)


def median_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.median_errors(_errors(spark, sf_dir)).select(F.round("t_median", 6).alias("t_median"), F.round("r_median", 6).alias("r_median"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of which some translations are NaN, some rotations of the first part NaN, and some of both NULL."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, nan = F.col("o_orderkey"), F.lit(float("nan"))
    t = F.when(k % 50 == 1, nan).when(k % 70 != 2, k * 7 % 97 / F.lit(10.0))
    r = F.when((k % 60 == 3) & (k % 2 == 1), nan).when(k % 70 != 3, k * 11 % 89 / F.lit(8.0))
    return o.select((k % 2).alias("part"), t.alias("t_err"), r.alias("r_err"))


def median_errors_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians where NaN occurs: translations leave it out, one NaN rotation makes the median NaN."""
    rows = _broken(spark, sf_dir)
    parts = [metrics.median_errors(rows.filter(F.col("part") == p)).select(F.lit(p).alias("part"), F.round("t_median", 6).alias("t_median"), F.isnan("r_median").alias("r_is_nan"), F.when(~F.isnan("r_median"), F.round("r_median", 6)).alias("r_median")) for p in (0, 1)]
    return parts[0].union(parts[1])


def accuracy_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and NULL errors pass no threshold but count as rows."""
    return metrics.accuracy_at_thresholds(_broken(spark, sf_dir), THRESHOLDS)


_BROKEN = """e AS (SELECT o_orderkey % 2 AS part, CASE WHEN o_orderkey % 50 = 1 THEN 'nan'::DOUBLE WHEN o_orderkey % 70 <> 2 THEN o_orderkey * 7 % 97 / 10e0 END AS t_err,
 CASE WHEN o_orderkey % 60 = 3 AND o_orderkey % 2 = 1 THEN 'nan'::DOUBLE WHEN o_orderkey % 70 <> 3 THEN o_orderkey * 11 % 89 / 8e0 END AS r_err FROM orders)"""


def pose_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of these errors fall on ties of rounding; both sides are moved off them."""
    errors = _errors(spark, sf_dir).select(F.greatest("t_err", "r_err").alias("err"))
    return metrics.pose_auc(errors, (5.0, 10.0, 20.0)).select("threshold", F.round(F.col("auc") + 1e-9, 5).alias("auc"))


def resample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 25 cameras each, about 20 m apart, resampled every 30 m."""
    c = cameras(spark, sf_dir)
    v = c.select(F.floor(F.col("entry_id") / 25).alias("line"), (F.col("entry_id") % 25).alias("seq"), (F.floor(F.col("entry_id") / 25) * 14.0).alias("x"), ((F.col("entry_id") % 25) * 22.0 + F.floor((F.col("entry_id") % 25) / 5) * 110.0).alias("y"))
    return spatial.resample_lines(v, 30.0).select("line", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


QUERIES = {
    f.__name__: f
    for f in (proximity_links, filter_distant_cameras, component_sizes, match_cooccurrence, displacement_policy, expansion_policy, min_support, accuracy_at_thresholds, median_errors, median_errors_nan, accuracy_with_nan, pose_auc, resample_lines)
}

_DISPLACED = f"""{_PAIRS},
bars AS (SELECT *, greatest({THRESHOLD}, coalesce(max(conf) OVER (PARTITION BY query_id, kp_idx ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {THRESHOLD})) AS bar FROM pairs),
last AS (SELECT *, row_number() OVER (PARTITION BY query_id, kp_idx ORDER BY i DESC, j DESC) AS n FROM bars WHERE ok AND conf > bar)"""
_CASES = " UNION ALL ".join(f"SELECT {t}e0 AS t_thr, {r}e0 AS r_thr" for t, r in THRESHOLDS)

ORACLES = {
    "proximity_links": f"WITH {_POSITIONS}, {_LINKS} SELECT g, i, j FROM links WHERE i < j",
    "filter_distant_cameras": f"""WITH RECURSIVE {_POSITIONS}, {_LINKS}, {_REACH}, s AS (SELECT g, comp, count(*) AS n FROM comp GROUP BY g, comp),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, comp) AS k FROM s) SELECT c.g, c.i FROM comp c JOIN b ON c.g = b.g AND c.comp = b.comp WHERE k = 1 AND n >= 2""",
    "component_sizes": f"WITH RECURSIVE {_POSITIONS}, {_LINKS}, {_REACH} SELECT g, comp, count(*) AS n FROM comp GROUP BY g, comp",
    "match_cooccurrence": f"WITH {_PAIRS} SELECT query_id, i, j, count(*) AS n, round(sum(conf), 6) AS conf FROM pairs GROUP BY query_id, i, j",
    "displacement_policy": f"WITH {_DISPLACED} SELECT query_id, kp_idx, i, j, round(conf, 6) AS conf FROM last WHERE n = 1",
    "expansion_policy": f"WITH {_PAIRS} SELECT query_id, i, j, count(*) AS n, CAST(sum(kp_idx) AS BIGINT) AS keypoints, round(sum(conf), 6) AS conf FROM pairs WHERE ok AND conf > {THRESHOLD} GROUP BY query_id, i, j",
    "min_support": f"WITH {_DISPLACED} SELECT query_id, count(*) AS points FROM last WHERE n = 1 GROUP BY query_id HAVING count(*) >= 4",
    "accuracy_at_thresholds": f"WITH {_ERRORS}, c AS ({_CASES}) SELECT t_thr, r_thr, round_even(avg(CASE WHEN t_err <= t_thr AND r_err <= r_thr THEN 1e0 ELSE 0e0 END), 2) AS accuracy FROM e, c GROUP BY t_thr, r_thr",
    "median_errors": f"WITH {_ERRORS} SELECT round(median(t_err), 6) AS t_median, round(median(r_err), 6) AS r_median FROM e",
    "median_errors_nan": f"""WITH {_BROKEN}, p AS (SELECT * FROM (VALUES (0), (1)) v(part)), m AS (SELECT p.part, median(t_err) FILTER (NOT isnan(t_err)) AS t, bool_or(isnan(r_err)) AS b, median(r_err) FILTER (NOT isnan(r_err)) AS r FROM p LEFT JOIN e ON e.part = p.part GROUP BY p.part)
SELECT CAST(part AS INTEGER) AS part, round(t, 6) AS t_median, b AS r_is_nan, CASE WHEN NOT b THEN round(r, 6) END AS r_median FROM m""",
    "accuracy_with_nan": f"WITH {_BROKEN}, c AS ({_CASES}) SELECT t_thr, r_thr, round_even(avg(CASE WHEN t_err <= t_thr AND r_err <= r_thr THEN 1e0 ELSE 0e0 END), 2) AS accuracy FROM e, c GROUP BY t_thr, r_thr",
    "pose_auc": f"""WITH {_ERRORS}, s AS (SELECT greatest(t_err, r_err) AS err, row_number() OVER (ORDER BY greatest(t_err, r_err)) AS k, count(*) OVER () AS m FROM e),
p AS (SELECT 0e0 AS err, 0e0 AS rec UNION ALL SELECT err, k / m::DOUBLE FROM s), t AS (SELECT * FROM (VALUES (5e0), (10e0), (20e0)) v(threshold)),
q AS (SELECT threshold, err, rec FROM p, t WHERE err < threshold UNION ALL SELECT threshold, threshold, max(rec) FROM p, t WHERE err < threshold GROUP BY threshold),
l AS (SELECT threshold, err, rec, lag(err) OVER (PARTITION BY threshold ORDER BY err, rec) AS e0, lag(rec) OVER (PARTITION BY threshold ORDER BY err, rec) AS r0 FROM q)
SELECT threshold, round(sum((err - e0) * (rec + r0) / 2) / threshold + 1e-9, 5) AS auc FROM l WHERE e0 IS NOT NULL GROUP BY threshold""",
    "resample_lines": """WITH l AS (SELECT CAST(floor(vec_id / 25e0) AS BIGINT) AS line, max((vec_id % 25) * 22e0 + floor((vec_id % 25) / 5e0) * 110e0) AS len FROM embeddings GROUP BY 1),
s AS (SELECT line, len, greatest(CAST(floor(len / 30) AS BIGINT), 1) AS parts FROM l WHERE len >= 20) SELECT line, n, line * 14e0 AS x, round(n * len / parts, 6) AS y FROM s, range(0, 100) g(n) WHERE n <= parts""",
}
