"""Shared helpers: scratch tables, text columns and Arrow chunking."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that a Python worker works on at once.
CHUNK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset in local mode
    (tests) a temporary folder is made once for the session; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("geolattice.local.scratch", None)
        if not base:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="geolattice-")
            spark.conf.set("geolattice.local.scratch", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage: the table outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geolattice/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if hasattr(spark, "_jsc"):  # the folder goes when the driver ends; until then lazy results may read it
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    plain = F.bit_length(text) == F.char_length(text) * 8
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_fold(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``. A NULL id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def small_slices(batches: Iterator[pa.RecordBatch], text_at: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into even parts of about ``limit`` bytes of text at most, or one long row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text_at))), 0).to_pylist()
        total = sum(lengths)
        even = total / max(1, -(-total // limit)) + 1
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > even:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or a variant that no column of ``taken`` has (names compare without case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted
