"""Pooling of features in long form (image, channel, value), batch moments, histograms, averages."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolattice.scratch import staged


def mac(features: DataFrame) -> DataFrame:
    return features.groupBy("image", "channel").agg(F.max("value").alias("x"))


def spoc(features: DataFrame) -> DataFrame:
    return features.groupBy("image", "channel").agg(F.avg("value").alias("x"))


def gem(features: DataFrame, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """Generalised mean: the p-th root of the mean of p-th powers of values held above eps."""
    return features.groupBy("image", "channel").agg(F.pow(F.avg(F.pow(F.greatest("value", F.lit(eps)), F.lit(p))), F.lit(1 / p)).alias("x"))


def _spread(span: int, size: int, n: int) -> list[int]:
    """n evenly spaced places for a window of ``size`` in ``span``, both ends included."""
    return [i * (span - size) // (n - 1) for i in range(n)] if n > 1 else [0]


def pooling_regions(width: int, height: int, levels: int, overlap: float = 0.4) -> list[tuple[int, int, int, int]]:
    """(top, left, height, width): the whole map, then for each level squares of side 2 * short / (level + 1).

    Level l has l squares along the shorter side. The longer side has as many more as bring
    the overlap of neighbours at the first level nearest to ``overlap``.
    """
    short, long = sorted((width, height))
    more = 0
    if long > short:
        more = min(range(1, 7), key=lambda m: abs(1 - (long - short) / (m * short) - overlap))
    found = [(0, 0, height, width)]
    for level in range(1, levels + 1):
        side = 2 * short // (level + 1)
        rows, columns = level + more * (height > width), level + more * (width > height)
        found += [(top, left, side, side) for top in _spread(height, side, rows) for left in _spread(width, side, columns) if side]
    return found


def rmac(features: DataFrame, width: int, height: int, levels: int = 3) -> DataFrame:
    """Sum of unit maximum vectors over the whole map and overlapping square regions of ``levels`` scales.

    Features are (image, channel, y, x, value) on a width*height grid. Regions are known from
    the grid alone; each cell goes to the regions that cover it.
    """
    regions = [(i, *r) for i, r in enumerate(pooling_regions(width, height, levels))]
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("id", "top", "left", "h", "w"), r, strict=True)]) for r in regions])
    covers = F.filter(listed, lambda r: (F.col("y") >= r["top"]) & (F.col("y") < r["top"] + r["h"]) & (F.col("x") >= r["left"]) & (F.col("x") < r["left"] + r["w"]))
    top = features.select("image", "channel", "value", F.explode(covers).alias("r")).groupBy("image", "channel", "r.id").agg(F.max("value").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("image", "id"))) + 1e-6
    return top.withColumn("u", F.col("m") / norm).groupBy("image", "channel").agg(F.sum("u").alias("x"))


def netvlad(features: DataFrame, centroids: DataFrame, alpha: float) -> DataFrame:
    """(image, k, channel, x): soft-assigned residuals to centroids, unit per centroid, then unit per image.

    Features are (image, cell, channel, value), centroids (k, channel, value), a small fixed table.
    """
    c = F.broadcast(centroids.select("k", "channel", F.col("value").alias("c")))
    joined = features.join(c, "channel")
    logits = joined.groupBy("image", "cell", "k").agg((F.sum(2 * alpha * F.col("value") * F.col("c") - alpha * F.col("c") * F.col("c"))).alias("z"))
    cell = Window.partitionBy("image", "cell")
    weights = logits.withColumn("e", F.exp(F.col("z") - F.max("z").over(cell))).select("image", "cell", "k", (F.col("e") / F.sum("e").over(cell)).alias("a"))
    sums = joined.join(weights, ["image", "cell", "k"]).groupBy("image", "k", "channel").agg(F.sum(F.col("a") * (F.col("value") - F.col("c"))).alias("v"))
    intra = sums.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("image", "k"))))
    return intra.select("image", "k", "channel", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("image")))).alias("x"))


def netvlad_init(features: DataFrame, clusters: int, images: int = 500, per_image: int = 100, rounds: int = 100, seed: int = 0) -> tuple[DataFrame, float]:
    """(centroids (k, channel, value), alpha) for ``netvlad``, from a bounded sample of unit cell descriptors.

    Features are (image, cell, channel, value); ``images`` images and of each ``per_image`` cells
    are drawn by hash, and k-means runs on them. alpha gives a cell's second-best centroid one
    hundredth of the weight of its best, on average over the sample.
    """
    draw = lambda *c: F.xxhash64(F.lit(seed), *c)
    chosen = features.select("image").distinct().orderBy(draw("image"), "image").limit(images)
    cells = features.join(F.broadcast(chosen), "image").groupBy("image", "cell").agg(F.sort_array(F.collect_list(F.struct("channel", "value"))).alias("v"))
    nth = Window.partitionBy("image").orderBy(draw("image", "cell"), "cell")
    cells = cells.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= per_image)
    values = F.transform("v", lambda x: x["value"])
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    unit = staged(cells.select(F.transform(values, lambda x: x / norm).alias("v")).filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x))"), "vlad-sample")
    fitted = KMeans(k=clusters, maxIter=rounds, seed=seed, featuresCol="f").fit(unit.select(array_to_vector("v").alias("f")))
    centers = [[float(x) for x in c] for c in fitted.clusterCenters()]
    spark = features.sparkSession
    table = spark.createDataFrame([(k, channel, x) for k, c in enumerate(centers) for channel, x in enumerate(c)], "k long, channel long, value double")
    length = [sum(x * x for x in c) ** 0.5 or 1.0 for c in centers]
    dots = F.array(*[F.aggregate(F.zip_with("v", F.lit([x / n for x in c]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) for c, n in zip(centers, length, strict=True)])
    ranked = unit.select(F.sort_array(dots, asc=False).alias("d"))
    gap = ranked.agg(F.avg(F.get("d", 0) - F.get("d", 1))).first()[0] if clusters > 1 else None
    return table, math.log(100.0) / gap if gap else 1.0


#: Aggregations by the name that a configuration gives them.
AGGREGATIONS = {"mac": mac, "spoc": spoc, "gem": gem, "rmac": rmac, "netvlad": netvlad}


def aggregation(name: str):
    """The pooling of that name, in any case; an unknown name raises KeyError."""
    return AGGREGATIONS[name.lower()]


def attention_pool(tokens: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(image, channel, x): softmax-weighted mean over tokens (image, token, score, channel, value)."""
    scores = tokens.select("image", "token", "score").distinct()
    top = scores.groupBy("image").agg(F.max("score").alias("top"))
    weight = F.exp((F.col("score") - F.col("top")) / temperature)
    weighted = tokens.join(top, "image").withColumn("w", weight)
    return weighted.groupBy("image", "channel").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("x"))


def batch_moments(values: DataFrame, eps: float = 1e-5, added: bool = False) -> DataFrame:
    """(channel, n, mean, var, unbiased, inv_std): moments from sums, sums of squares and counts that tasks pre-aggregate.

    ``eps`` is the least variance of inv_std or, with ``added``, a summand of it.
    """
    sums = values.groupBy("channel").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    spread = F.col("ss") - F.col("s") * (F.col("s") / F.col("n"))
    return sums.select("channel", "n", (F.col("s") / F.col("n")).alias("mean"), (spread / F.col("n")).alias("var"), F.when(F.col("n") > 1, spread / (F.col("n") - 1)).alias("unbiased"), (1 / F.sqrt(spread / F.col("n") + eps if added else F.greatest(spread / F.col("n"), F.lit(eps)))).alias("inv_std"))


def ema(values: DataFrame, key: str, order: str, decay: float) -> DataFrame:
    """(key, ema): moving average with weight ``decay`` on the past, in closed form: no list of values is gathered."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    age = F.row_number().over(w) - 1
    n = F.count("*").over(Window.partitionBy(key))
    weight = F.pow(F.lit(decay), F.col("age")) * F.when(F.col("age") == F.col("n") - 1, 1.0).otherwise(1 - decay)
    return values.withColumns({"age": age, "n": n}).groupBy(key).agg(F.sum(weight * F.col("value")).alias("ema"))


def clip_range(histogram: DataFrame, clip_percent: float) -> DataFrame:
    """(lo, hi, alpha, beta): gray levels left after cutting half the percentage from each tail of (level, n), and the stretch to 0..255."""
    total = histogram.agg(F.sum("n").alias("total"))
    cum = histogram.withColumn("cum", F.sum("n").over(Window.orderBy("level"))).join(F.broadcast(total))  # at most 256 levels
    cut = F.col("total") * (clip_percent / 200.0)
    ends = cum.agg(F.min(F.when(F.col("cum") >= cut, F.col("level"))).alias("lo"), F.max(F.when(F.col("cum") < F.col("total") - cut, F.col("level"))).alias("hi"))
    alpha = 255.0 / (F.col("hi") - F.col("lo"))
    return ends.select("lo", "hi", alpha.alias("alpha"), (-F.col("lo") * alpha).alias("beta"))
