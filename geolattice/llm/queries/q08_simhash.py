"""op8: near-duplicates of documents by 64-bit SimHash, linked at two differing bits or fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolattice.llm.simhash import near_duplicates

NAME = "op8_simhash_near_dedup"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
