"""op6: quality of documents, learned outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.common import in_fold
from geolattice.llm.quality import fit_quality, score_quality

NAME = "op6_quality"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit_quality(docs.filter(~held_out), labels.filter(~held_out))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
