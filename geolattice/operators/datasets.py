"""Dataset building: keep-first deduplication, chunks, headings, updates, complements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.scratch import staged


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a minimum over whole rows, so no group is sorted or collected."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = F.min(F.struct(order, *rest)).alias("_first")
    return rows.groupBy(key).agg(first).select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def numbered(rows: DataFrame, order: str, cells: int = 64) -> DataFrame:
    """Adds _n, the position in the order of a unique column, from 0.

    Rows are cut into ranges first; counts per range, one row each, give the offsets, so no
    task holds all rows.
    """
    # written out: the ranges are drawn from a sample and must be the same for counts and rows
    ranged = staged(rows.repartitionByRange(cells, order).withColumn("_cell", F.spark_partition_id()), "ranges")
    inner = F.row_number().over(Window.partitionBy("_cell").orderBy(order)) - 1
    placed = ranged.withColumn("_inner", inner)
    sizes = rows.sparkSession.createDataFrame(ranged.groupBy("_cell").agg(F.count("*").alias("m")).collect(), "_cell int, m long")
    before = F.coalesce(F.sum("m").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("_cell", before.alias("_before"))), "_cell").withColumn("_n", F.col("_before") + F.col("_inner")).drop("_cell", "_inner", "_before")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk and pos: consecutive slices of ``size`` rows."""
    return numbered(rows, order).withColumns({"chunk": F.floor(F.col("_n") / size).cast("long"), "pos": F.pmod(F.col("_n"), F.lit(size)).cast("long")}).drop("_n")


def every_nth(rows: DataFrame, order: str, skip: int, most: int) -> DataFrame:
    """Every ``skip``-th row in order, at most ``most`` of them (a sampling operator)."""
    return numbered(rows, order).filter((F.col("_n") % skip == 0) & (F.col("_n") < skip * most)).drop("_n")


def headings(entries: DataFrame, n: int) -> DataFrame:
    """Adds heading: one row for each multiple of 360 // n below 360, which may be more than n."""
    return entries.withColumn("heading", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(360 // n))))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with the non-null values of ``new`` over their own."""
    given = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    joined = old.join(given, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c != key and c in new.columns else F.col(c) for c in old.columns])


def in_split(id_col: Column, share: float, seed: int) -> Column:
    """Whether a row falls into the test part; depends on id and seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(share * 1_000_000)
