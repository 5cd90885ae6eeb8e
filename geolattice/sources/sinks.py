"""Writers: descriptors, keypoints, updated metadata, experiments and submission text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.functions import camera


def write_descriptors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("descriptor_type").parquet(path)


def write_keypoints(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Writes to a path that must not exist: converted and updated datasets never overwrite what they read."""
    df.write.mode("errorifexists").parquet(path)


def write_experiment(df: DataFrame, root: str, name: str) -> None:
    """Results (entry_id, gt, est, status) under exp_name=<name>."""
    df.withColumn("exp_name", F.lit(name)).write.mode("append").partitionBy("exp_name").parquet(root)


def submission_lines(poses: DataFrame) -> DataFrame:
    """(value): 'name.jpg qw qx qy qz tx ty tz' with nine digits, in order of names; w is never negative."""
    q = camera.matrix_to_quaternion(F.col("R"))
    numbers = poses.select("name", F.concat(q, F.col("T")).alias("n"))
    shown = F.array_join(F.transform("n", lambda x: F.format_string("%.9f", x + 0.0)), " ")
    return numbers.orderBy("name").select(F.concat_ws(" ", F.concat("name", F.lit(".jpg")), shown).alias("value"))


def write_submission(poses: DataFrame, path: str) -> None:
    """One text file; poses are one short line per query image."""
    submission_lines(poses).coalesce(1).write.mode("overwrite").text(path)
