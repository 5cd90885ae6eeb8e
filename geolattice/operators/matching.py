"""Keypoint algebra from the published papers: suppression, borders, top scores, mutual matches, optimal transport."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolattice.scratch import staged


def suppress(points: DataFrame, radius: int) -> DataFrame:
    """Points (image, y, x, score) that no other point within ``radius`` pixels (a square) beats; equal scores stay.

    Cells of the radius's size meet their neighbours by equality, so only near points compare.
    """
    size = radius + 1
    cell = points.withColumns({"cy": F.floor(F.col("y") / size), "cx": F.floor(F.col("x") / size)})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    others = cell.withColumn("d", around).select("image", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("score").alias("s2"), (F.col("cy") + F.col("d.a")).alias("cy"), (F.col("cx") + F.col("d.b")).alias("cx"))
    near = cell.join(others, ["image", "cy", "cx"]).filter((F.abs(F.col("y") - F.col("y2")) <= radius) & (F.abs(F.col("x") - F.col("x2")) <= radius))
    best = near.groupBy("image", "y", "x", "score").agg(F.max("s2").alias("top"))
    return best.filter("score >= top").select("image", "y", "x", "score")


def inside_border(points: DataFrame, border: int, height: int, width: int) -> DataFrame:
    return points.filter((F.col("y") >= border) & (F.col("y") < height - border) & (F.col("x") >= border) & (F.col("x") < width - border))


def top_keypoints(points: DataFrame, k: int) -> DataFrame:
    """The k best points of each image, all if k is negative; ties by position."""
    if k < 0:
        return points
    order = Window.partitionBy("image").orderBy(F.desc("score"), "y", "x")
    return points.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def mutual_matches(scores: DataFrame, threshold: float) -> DataFrame:
    """(pair, i, j, score): entries of (pair, i, j, score) that are the best of their row and of their column, over the threshold."""
    rows = scores.groupBy("pair", "i").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("j").alias("j"))).alias("b")).select("pair", "i", F.col("b.j").alias("j"))
    cols = scores.groupBy("pair", "j").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("i").alias("i"))).alias("b")).select("pair", F.col("b.i").alias("i"), "j")
    return scores.join(rows, ["pair", "i", "j"]).join(cols, ["pair", "i", "j"]).filter(F.col("score") > threshold).select("pair", "i", "j", "score")


def normalized_keypoints(points: DataFrame, width: float, height: float) -> DataFrame:
    """Centres coordinates and divides them by 0.7 of the longer side."""
    scale = 0.7 * max(width, height)
    return points.withColumns({"x": (F.col("x") - width / 2) / scale, "y": (F.col("y") - height / 2) / scale})


def _log_sums(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each run of entries that begins at ``start``."""
    top = np.maximum.reduceat(value, start)
    return top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(start, append=len(value)))), start))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _transport(pair: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, blank: np.ndarray, dustbin: float, rounds: int) -> tuple[np.ndarray, ...]:
    """(pair, i, j, z, blank) of whole pairs, numbered from 0; a blank score counts for nothing."""
    n_pairs = int(pair.max()) + 1
    m, n = np.zeros(n_pairs, dtype=np.int64), np.zeros(n_pairs, dtype=np.int64)
    np.maximum.at(m, pair, i + 1)
    np.maximum.at(n, pair, j + 1)
    once = lambda at: (lambda o: o[_starts(pair[o], at[o])])(np.lexsort((at, pair)))
    rows, cols, every = once(i), once(j), np.arange(n_pairs)
    bins = len(rows) + len(cols) + n_pairs
    i = np.concatenate([i, i[rows], np.full(len(cols) + n_pairs, -1)])
    j = np.concatenate([j, np.full(len(rows), -1), j[cols], np.full(n_pairs, -1)])
    pair, score = np.concatenate([pair, pair[rows], pair[cols], every]), np.concatenate([np.where(blank, -np.inf, score), np.full(bins, dustbin)])
    blank = np.concatenate([blank, np.zeros(bins, dtype=bool)])
    norm = -np.log(m + n)
    order = np.lexsort((j, i, pair))
    pair, i, j, value, blank = pair[order], i[order], j[order], score[order], blank[order]
    by_col = np.lexsort((i, j, pair))
    row_start, col_start = _starts(pair, i), _starts(pair[by_col], j[by_col])
    at = by_col[col_start]
    mu = norm[pair[row_start]] + np.where(i[row_start] < 0, np.log(n)[pair[row_start]], 0)
    nu = norm[pair[at]] + np.where(j[at] < 0, np.log(m)[pair[at]], 0)
    row_of = np.repeat(np.arange(len(row_start)), np.diff(row_start, append=len(i)))
    col_of = np.empty(len(i), dtype=np.int64)
    col_of[by_col] = np.repeat(np.arange(len(col_start)), np.diff(col_start, append=len(i)))
    u, v = np.zeros(len(row_start)), np.zeros(len(col_start))
    for _ in range(rounds):
        u = mu - _log_sums(value + v[col_of], row_start)
        v = nu - _log_sums((value + u[row_of])[by_col], col_start)
    return pair, i, j, value + u[row_of] + v[col_of] - norm[pair], blank


def sinkhorn(scores: DataFrame, dustbin: float, rounds: int) -> DataFrame:
    """(pair, i, j, z): log transport plan of a score table with a dustbin row and column.

    Scores are (pair, i, j, score) with complete i and j from 0. The dustbins have index -1 and
    take what matches nothing. Rows and columns are normalised in turn, in logs. One shuffle
    brings a pair's rows together; a task then solves as many whole pairs at once as lie in its
    Arrow batches, each bounded by the keypoints of two images.
    """
    kind = scores.schema["pair"].dataType.simpleString()
    table = scores.select("pair", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("score").cast("double").alias("score")).filter("pair IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL")

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table.column("pair").combine_chunks()
        new = np.ones(len(names), dtype=bool)
        new[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
        i, j = (table.column(c).to_numpy() for c in ("i", "j"))
        score = table.column("score")
        pair, i, j, z, blank = _transport(np.cumsum(new) - 1, i, j, score.to_numpy(), score.is_null().to_numpy(), dustbin, rounds)
        yield from pa.table({"pair": names.take(pa.array(np.flatnonzero(new)[pair])), "i": i, "j": j, "z": pa.array(z, mask=blank)}).to_batches(65536)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last pair, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = pc.index(pc.equal(batch.column("pair"), batch.column("pair")[-1]), True).as_py()
            if last or (held and held[-1].column("pair")[-1] != batch.column("pair")[-1]):
                yield from solved(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from solved(pa.Table.from_batches(held))

    return table.repartition("pair").sortWithinPartitions("pair").mapInArrow(whole, f"pair {kind}, i long, j long, z double")


def sampled_descriptors(grid: DataFrame, points: DataFrame, cell: int = 8) -> DataFrame:
    """(image, y, x, channel, v): bilinear samples of a descriptor grid at 1/cell resolution, unit length per point.

    Grid rows are (image, gy, gx, channel, value); four corners meet each point by equality, and
    corners off the grid count as zero.
    """
    gy, gx = (F.col("y") - cell / 2 + 0.5) / cell, (F.col("x") - cell / 2 + 0.5) / cell
    placed = points.withColumns({"fy": gy, "fx": gx})
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    at = placed.withColumn("c", corners).withColumns({"gy": (F.floor("fy") + F.col("c.a")).cast("long"), "gx": (F.floor("fx") + F.col("c.b")).cast("long")})
    share = lambda f, c: F.when(c == 1, f - F.floor(f)).otherwise(1 - (f - F.floor(f)))
    weighted = at.withColumn("w", share(F.col("fy"), F.col("c.a")) * share(F.col("fx"), F.col("c.b"))).join(grid, ["image", "gy", "gx"])
    summed = weighted.groupBy("image", "y", "x", "channel").agg(F.sum(F.col("w") * F.col("value")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("image", "y", "x")))
    return summed.select("image", "y", "x", "channel", F.when(norm > 0, F.col("v") / norm).alias("v"))


def descriptor_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, i, j, score): inner products over the root of the length, of the descriptors (pair, kp_idx, desc) of both images of a pair.

    A pair is one group, bounded by the keypoints of two images.
    """

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"pair": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        i, j = a.column("kp_idx").to_numpy().astype(np.int64), b.column("kp_idx").to_numpy().astype(np.int64)
        x, y = (np.array(t.column("desc").to_pylist(), dtype=float) for t in (a, b))
        s = x @ y.T / x.shape[1] ** 0.5
        return pa.table({"pair": np.full(s.size, a.column("pair")[0].as_py(), dtype=np.int64), "i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "score": s.reshape(-1)})

    return left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(score, "pair long, i long, j long, score double")


def match_descriptors(left: DataFrame, right: DataFrame, dustbin: float = 1.0, rounds: int = 100, threshold: float = 0.2) -> DataFrame:
    """(pair, i, j, confidence): mutual best matches of the transport plan between the keypoints of two images.

    Keypoints are (pair, kp_idx, desc), with kp_idx from 0 without gaps. ``score`` tables of
    another matcher go through ``sinkhorn`` and ``mutual_matches`` alike.
    """
    plan = sinkhorn(staged(descriptor_scores(left, right), "scores"), dustbin, rounds)
    inner = plan.filter("i >= 0 AND j >= 0").select("pair", "i", "j", F.exp("z").alias("score"))
    return mutual_matches(staged(inner, "plan"), threshold).withColumnRenamed("score", "confidence")


def detect_and_match(left: DataFrame, right: DataFrame, detector: Callable[[DataFrame], DataFrame], **matching) -> DataFrame:
    """Matches of images: sides without descriptors go through the detector first, which gives (pair, kp_idx, desc)."""
    sides = [side if "desc" in side.columns else detector(side) for side in (left, right)]
    return match_descriptors(*sides, **matching)
