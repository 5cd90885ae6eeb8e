"""Retrieval and pose-accuracy metrics over ranked lists held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def map_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """(qid, ap): average precision at k of (qid, rank, rel); always divided by k."""
    hits = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank"))
    return ranked.filter(F.col("rank") <= k).withColumn("hits", hits).groupBy("qid").agg((F.sum(F.col("rel") * F.col("hits") / F.col("rank")) / k).alias("ap"))


def cmc(ranked: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """(cut, share): share of all queries with a relevant row within each cut."""
    first = ranked.groupBy("qid").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    points = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    return first.select("first", points).groupBy("cut").agg(F.avg(F.when(F.col("first") <= F.col("cut"), 1.0).otherwise(0.0)).alias("share"))


def average_precision_without_junk(ranked: DataFrame) -> DataFrame:
    """(qid, ap) of (qid, rank, good, junk): junk rows leave the list, then precision is averaged by trapezoids.

    The precision before the first position counts as one. Queries without a good row give no row.
    """
    order = Window.partitionBy("qid").orderBy("rank")
    kept = ranked.filter("junk = 0").withColumn("pos", F.row_number().over(order) - 1)
    good = kept.filter("good = 1").withColumn("n", F.row_number().over(order))
    total = Window.partitionBy("qid")
    precision = F.col("n") / (F.col("pos") + 1)
    before = F.when(F.col("pos") == 0, 1.0).otherwise((F.col("n") - 1) / F.col("pos"))
    return good.withColumn("part", (precision + before) / 2 / F.count("*").over(total)).groupBy("qid").agg(F.sum("part").alias("ap"))


def accuracy_at_thresholds(errors: DataFrame, thresholds: tuple[tuple[float, float], ...]) -> DataFrame:
    """(t_thr, r_thr, accuracy): rounded share of rows within both thresholds; NaN and NULL errors are outside."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("t_thr"), F.lit(r).alias("r_thr")) for t, r in thresholds])).alias("x")
    inside = (F.coalesce(F.col("t_err"), F.lit(float("nan"))) <= F.col("x.t_thr")) & (F.coalesce(F.col("r_err"), F.lit(float("nan"))) <= F.col("x.r_thr"))
    return errors.select("t_err", "r_err", rows).groupBy("x.t_thr", "x.r_thr").agg(F.bround(F.avg(F.when(inside, 1.0).otherwise(0.0)), 2).alias("accuracy"))


def median_errors(errors: DataFrame) -> DataFrame:
    """(t_median, r_median): NaN translations are left out; one NaN rotation makes the rotation's median NaN."""
    nan = F.lit(float("nan"))
    return errors.agg(F.median(F.when(~F.isnan("t_err"), F.col("t_err"))).alias("t_median"), F.when(F.bool_or(F.isnan("r_err")), nan).otherwise(F.median("r_err")).alias("r_median"))


def pose_auc(errors: DataFrame, thresholds: tuple[float, ...], cells_per_unit: int = 4) -> DataFrame:
    """(threshold, auc): area under recall over error up to each threshold, by trapezoids, over the threshold.

    Recall is held flat from the last error below a threshold up to it; a threshold below all
    errors has area zero. Equal errors are counted first; the running count is kept per cell
    of error values and carried over by a table of one row per cell.
    """
    total = F.lit(float(errors.count()))
    counted = errors.groupBy("err").agg(F.count("*").alias("n")).withColumn("cell", F.floor(F.col("err") * cells_per_unit))
    order = Window.partitionBy("cell").orderBy("err")
    inner = counted.withColumns({"upto": F.sum("n").over(order), "prev": F.lag("err").over(order)})
    per_cell = counted.groupBy("cell").agg(F.sum("n").alias("m"), F.max("err").alias("top"))
    along = Window.orderBy("cell")
    carry = per_cell.select("cell", F.coalesce(F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.coalesce(F.lag("top").over(along), F.lit(0.0)).alias("last"))
    curve = inner.join(carry, "cell").select("err", F.coalesce("prev", "last").alias("prev"), ((F.col("before") + F.col("upto") - F.col("n")) / total).alias("low"), ((F.col("before") + F.col("upto")) / total).alias("high"))
    points = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = curve.select("*", points)
    below = F.col("err") < F.col("threshold")
    area = F.when(below, (F.col("err") - F.col("prev")) * (2 * F.col("low") + 1 / total) / 2).otherwise(0.0)
    flat = F.coalesce(F.max(F.when(below, F.col("high"))), F.lit(0.0)) * (F.col("threshold") - F.coalesce(F.max(F.when(below, F.col("err"))), F.col("threshold")))
    return rows.groupBy("threshold").agg(((F.sum(area) + flat) / F.col("threshold")).alias("auc"))
