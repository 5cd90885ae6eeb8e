"""op5: language of documents, learned outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.common import in_fold
from geolattice.llm.language_id import fit_language_model, identify

NAME = "op5_language_id"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit_language_model(docs.filter(~held_out))
    return identify(docs, model).withColumn("held_out", held_out)
