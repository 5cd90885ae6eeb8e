"""Tables derived from the driver's, as Spark SQL and as SQL that DuckDB runs too.

Only integer arithmetic and one division by a DOUBLE literal, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CAMERAS = """
SELECT CAST(vec_id AS BIGINT) AS entry_id, 640 AS w, 640 AS h,
       49.84e0 + ((vec_id % 25) * 2 + floor((vec_id % 25) / 5e0) * 10) / 1e4 AS lat,
       24.03e0 + floor(vec_id / 25e0) * 2 / 1e4 AS lng,
       CAST(290 + vec_id % 7 AS DOUBLE) AS alt, CAST(45 * (vec_id % 8) AS DOUBLE) AS azn, 90e0 AS fov
FROM embeddings
"""

def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    return vectors.selectExpr(
        "vec_id AS entry_id",
        "640 AS w",
        "640 AS h",
        "49.84D + ((vec_id % 25) * 2 + floor((vec_id % 25) / 5D) * 10) / 1e4D AS lat",
        "24.03D + floor(vec_id / 25D) * 2 / 1e4D AS lng",
        "CAST(290 + vec_id % 7 AS DOUBLE) AS alt",
        "CAST(45 * (vec_id % 8) AS DOUBLE) AS azn",
        "90D AS fov",
    )


def matches(spark: SparkSession, sf_dir: str, refs: int = 6, points: int = 32) -> DataFrame:
    """(query_id, ref_rank, kp_idx, ref_kp_idx, confidence) for every vector as query."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    rows = vectors.selectExpr("vec_id AS q", f"explode(sequence(0L, {refs - 1}L)) AS r").selectExpr("q", "r", f"explode(sequence(0L, {points - 1}L)) AS k")
    return rows.selectExpr("q AS query_id", "r AS ref_rank", "k AS kp_idx", "(k * 7 + r) % 32 AS ref_kp_idx", "((k * 37 + r * 91 + q * 53) % 1000) / 1e3D AS confidence")


SQL_CAMERAS = f"cameras AS ({CAMERAS})"


def sql_matches(refs: int = 6, points: int = 32) -> str:
    return f"""matches AS (
  SELECT vec_id AS query_id, r AS ref_rank, k AS kp_idx, (k * 7 + r) % 32 AS ref_kp_idx, ((k * 37 + r * 91 + vec_id * 53) % 1000) / 1e3 AS confidence
  FROM embeddings, range(0, {refs}) a(r), range(0, {points}) b(k)
)"""
