"""Exact search by inner products in blocks.

A query set of one block, counted first, goes out with the tasks: the gallery is neither
broadcast, collected nor shuffled, and a task multiplies each Arrow batch of its gallery rows
with the block and keeps its best k per query. Larger query sets never meet the driver: both
sides are cut into blocks of bounded size, each pair of blocks is one group of a shuffle, and
gives its best k per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolattice.functions.vectors import as_double, l2_normalize

BLOCK_ROWS = 4096


def normalized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): unit vectors in DOUBLE; NULL and zero vectors are dropped."""
    return vectors.select(F.col(id_col).alias("id"), l2_normalize(as_double(F.col(vec_col))).alias("v")).filter("v IS NOT NULL")


def raw_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors as they are, in DOUBLE; NULL vectors are dropped."""
    return vectors.select(F.col(id_col).alias("id"), as_double(F.col(vec_col)).alias("v")).filter("v IS NOT NULL")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Best:
    """The k best gallery rows so far for each query of a block."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, k: int, keep_self: bool) -> None:
        self.ids, self.block, self.k, self.keep_self = ids, block, k, keep_self
        self.score = np.full((len(ids), 0), -np.inf)
        self.other = np.zeros((len(ids), 0), dtype=np.int64)

    def see(self, gid: np.ndarray, vectors: np.ndarray) -> None:
        s = self.block @ vectors.T
        s[np.isnan(s)] = -np.inf
        if not self.keep_self:
            s[self.ids[:, None] == gid[None, :]] = -np.inf
        (n, held), width = self.score.shape, s.shape[1]
        # rows near the k-th score or better, as they may tie with it once rounded
        low = self.score[:, -1] if held == self.k else np.partition(s, width - self.k, axis=1)[:, width - self.k] if width > self.k else np.full(n, -np.inf)
        row, at = np.nonzero(s >= np.where(np.isfinite(low), low - 2e-9 - 1e-15 * np.abs(low), low)[:, None])
        owner = np.concatenate([np.repeat(np.arange(n), held), row])
        score, other = np.concatenate([self.score.reshape(-1), s[row, at]]), np.concatenate([self.other.reshape(-1), gid[at]])
        # rounding first, so that ties fall to the smaller id as in the final ranking
        order = np.lexsort((other, -np.round(score, 9), owner))
        first = np.searchsorted(owner[order], np.arange(n))
        take = order[first[:, None] + np.arange(min(self.k, held + width))]
        self.score, self.other = score[take], other[take]

    def columns(self) -> list[pa.Array]:
        found = np.isfinite(self.score)
        qid = np.broadcast_to(self.ids[:, None], self.score.shape)
        return [pa.array(qid[found]), pa.array(self.other[found]), pa.array(self.score[found])]


_FOUND = "qid long, gid long, score double"
_NAMES = ["qid", "gid", "score"]


def _best_of_task(ids: np.ndarray, block: np.ndarray, k: int, keep_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, block, k, keep_self)
        for batch in batches:
            if batch.num_rows:
                best.see(batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v")))
        yield pa.RecordBatch.from_arrays(best.columns(), names=_NAMES)

    return run


def _best_of_blocks(k: int, keep_self: bool, rows: int = 4096):
    def run(gallery: pa.Table, queries: pa.Table) -> pa.Table:
        if not gallery.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=_NAMES)
        parts = []
        gid, vectors = gallery.column("id").to_numpy(), _matrix(gallery.column("v").combine_chunks())
        qid, asked = queries.column("qid").to_numpy(), _matrix(queries.column("qv").combine_chunks())
        for q in range(0, len(qid), 1024):
            best = Best(qid[q : q + 1024], asked[q : q + 1024], k, keep_self)
            for g in range(0, len(gid), rows):
                best.see(gid[g : g + rows], vectors[g : g + rows])
            parts.append(pa.table(best.columns(), names=_NAMES))
        return pa.concat_tables(parts)

    return run


def _by_blocks(gallery: DataFrame, queries: DataFrame, n_queries: int, k: int, keep_self: bool, block_rows: int) -> DataFrame:
    """Candidates from all pairs of blocks; each side goes once to every block of the other."""
    n_gallery = gallery.count()
    across, down = max(1, -(-n_gallery // (4 * block_rows))), max(1, -(-n_queries // (4 * block_rows)))
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = across * down
    left = gallery.select("id", "v", cell(across).alias("_g"), every(down).alias("_q")).repartition(parts, "_g", "_q").groupBy("_g", "_q")
    # names of its own, as both sides may be one table
    right = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"), cell(down).alias("_q"), every(across).alias("_g")).repartition(parts, "_g", "_q").groupBy("_g", "_q")
    return left.cogroup(right).applyInArrow(_best_of_blocks(k, keep_self), _FOUND)


def cosine_topk(gallery: DataFrame, queries: DataFrame, k: int, keep_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, gid, rank, score): the k gallery rows of largest inner product with each query, ties by the smaller id.

    Both sides are (id long, v array<double>) with vectors of one length; unit vectors give
    the cosine. A query never finds its own id unless ``keep_self``. Fewer than k rows come
    back from a smaller gallery.
    """
    asked = queries.select("id", "v").limit(block_rows + 1).collect()  # one block and one row at most
    if len(asked) <= block_rows:
        ids, block = np.array([r.id for r in asked], dtype=np.int64), np.array([r.v for r in asked])
        if not len(ids):
            return gallery.sparkSession.createDataFrame([], "qid long, gid long, rank int, score double")
        found = gallery.select("id", "v").mapInArrow(_best_of_task(ids, block, k, keep_self), _FOUND)
    else:
        found = _by_blocks(gallery, queries, queries.count(), k, keep_self, block_rows)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "gid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "gid", "rank", "score")
