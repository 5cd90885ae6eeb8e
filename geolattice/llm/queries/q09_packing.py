"""op9: all documents in sequences of at most 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolattice.llm.packing import pack

NAME = "op9_packing"
SQL = None


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
