"""Distances of a stated query set to all rows, in blocks: every pair is a row of the result.

A block of queries, a bounded number of rows, goes out with the tasks and meets each Arrow
batch of the other side there; nothing is shuffled. The result has a row per query and row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolattice.operators.knn import _matrix

BLOCK_ROWS = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|x|^2 + |y|^2 - 2 x.y of all rows, held at zero."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0)


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle in degrees between rotations given as rows of nine entries."""
    return np.degrees(np.arccos(np.clip((x @ y.T - 1) / 2, -1.0, 1.0)))


def _all_pairs(ids: np.ndarray, block: np.ndarray, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                gid, d = part.column("id").to_numpy(zero_copy_only=False), measure(block, _matrix(part.column("v")))
                columns = [np.repeat(ids, len(gid)), np.tile(gid, len(ids)), d.reshape(-1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "gid", "d"])

    return run


def pairwise(queries: DataFrame, rows: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] = squared, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, gid, d): the measure of every query and every row; both are (id long, v array<double>) of one length."""
    blocks = max(1, -(-queries.count() // block_rows))
    parts = []
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        asked = mine.select("id", "v").collect()  # about block_rows rows
        if asked:
            ids, block = np.array([r.id for r in asked], dtype=np.int64), np.array([r.v for r in asked])
            parts.append(rows.select("id", "v").mapInArrow(_all_pairs(ids, block, measure), "qid long, gid long, d double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "qid long, gid long, d double")
    return reduce(DataFrame.union, parts)


def camera_distances(queries: DataFrame, rows: DataFrame, widest: float = 90.0) -> DataFrame:
    """(qid, gid, d): distances of camera positions; infinity where the views part by more than ``widest`` degrees.

    Both sides are (id, r array of 9, c array of 3).
    """
    both = lambda df: df.select("id", F.concat("r", "c").alias("v"))

    def measure(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.sqrt(((x[:, None, 9:] - y[None, :, 9:]) ** 2).sum(axis=2))
        return np.where(angle(x[:, :9], y[:, :9]) > widest, np.inf, d)

    return pairwise(both(queries), both(rows), measure)


def order_k(distances: DataFrame, k: int) -> DataFrame:
    """(qid, gid, rank, d): the k smallest of each query, ties by the smaller id; infinite ones enter where fewer than k are finite."""
    order = Window.partitionBy("qid").orderBy("d", "gid")
    return distances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "gid", "rank", "d")


def agreement(found: DataFrame, nearest: DataFrame) -> DataFrame:
    """(qid, rank, rel): for each row of a ranked list whether it is in the query's other list."""
    hit = nearest.select("qid", "gid", F.lit(1).alias("_rel"))
    return found.join(hit, ["qid", "gid"], "left").select("qid", "rank", F.coalesce("_rel", F.lit(0)).alias("rel"))
