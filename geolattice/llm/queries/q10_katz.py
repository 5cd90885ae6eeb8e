"""op10: Katz backoff scores of documents, trained outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.common import in_fold
from geolattice.llm.katz import score_katz

NAME = "op10_katz_scores"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_katz(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~in_fold(F.col("doc_id"), 7, 2))
