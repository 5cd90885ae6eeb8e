"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster names the folder in ``spark.checkpoint.dir``; local sessions get a temporary one, others raise without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("geolattice.local.scratch", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="geolattice-")
        spark.conf.set("geolattice.local.scratch", base)
    return base.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and reads it back, so that later stages neither recompute nor depend on its lineage."""
    path = f"{shared_folder(df.sparkSession)}/geolattice/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_later(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget_later(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends; until then lazy results may read it."""
    if hasattr(spark, "_jsc"):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
