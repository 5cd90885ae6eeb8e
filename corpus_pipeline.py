"""Corpus preparation: language, exact copies, near copies, benchmark passages, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its
predecessor kept. All but the last return the columns of ``documents``.

NULL texts and texts without a letter go with the first stage; given to a later one alone, a
NULL text counts as empty. Texts of any length are worked on whole. Rows that repeat an id are
judged by their text. An empty table gives an empty table, and columns beside doc_id, text and
lang may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.common import in_fold, materialize
from geolattice.llm.decontaminate import find_contamination
from geolattice.llm.exact_dedup import exact_dedup
from geolattice.llm.language_id import fit_language_model, keep_identified
from geolattice.llm.packing import pack
from geolattice.llm.queries.q09_packing import vocabulary
from geolattice.llm.simhash import keep_representatives


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; learned outside the held-out fold."""
    return keep_identified(docs, fit_language_model(docs.filter(~in_fold(F.col("doc_id"), 5, 0))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs, carry=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 1024 tokens."""
    return pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has neither the compression model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
