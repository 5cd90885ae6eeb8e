"""Scores of graph re-ranking where the neighbour graph, not its propagated rows, fits a task.

With the k2 nearest neighbours as weights W, the symmetric edge table S and L the lengths of the
rows of W S, the table that is spread the second time is T = L^-1 W S + S W^T L^-1, and a node's
propagated row is its row of W T. Rows hold hundreds of entries after one spreading and thousands
after two, so none is written out: products with W and S give the rows of a block of queries,
and products of those rows with T and W the scores against all nodes. Lengths of rows are summed
a few rows at a time. Only the neighbour lists go to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neighbours that are handed to every task at most; queries of a block; numbers of a dense block and of a slice of products.
MOST_NEIGHBOURS, BLOCK, DENSE, SLICE = 6_000_000, 16, 2_000_000, 1 << 16
#: Products of smaller weights could vanish.
LEAST_WEIGHT = 1e-60


class Sparse:
    """Rows of (column, value) entries; values are 1 where none are given, and entries of one column add up."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray | None, n: int) -> None:
        order = np.argsort(row, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        self.col, self.val = col[order].astype(np.int32), None if val is None else val[order]

    def times(self, x: np.ndarray) -> np.ndarray:
        """The product with a dense block, in slices of whole rows."""
        n = len(self.start) - 1
        out, a = np.zeros((n, x.shape[1])), 0
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.start, self.start[a] + SLICE // x.shape[1], "right")) - 1))
            s, e = self.start[a], self.start[b]
            if e > s:
                part = x[self.col[s:e]]
                if self.val is not None:
                    part *= self.val[s:e, None]
                full = np.flatnonzero(self.start[a + 1 : b + 1] > self.start[a:b]) + a
                out[full] = np.add.reduceat(part, self.start[full] - s, axis=0)
            a = b
        return out

    def along(self, owner: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (owner, node, value), each replaced by the row of its node times its value."""
        n = self.start[node + 1] - self.start[node]
        at = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
        value = np.repeat(value, n)
        return np.repeat(owner, n), self.col[at], value if self.val is None else value * self.val[at]


class Graph:
    """Neighbour lists by position in the sorted ids: ``start`` of each list, ``near`` by rank, ``weight`` of the k2 nearest."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, near: np.ndarray, first: np.ndarray, weight: np.ndarray) -> None:
        self.ids, self.owner, self.near, self.first, self.weight = ids, owner, near, first, weight
        self.length = np.ones(len(ids))

    def open(self) -> Graph:
        """The tables of products, built where they are used."""
        n = len(self.ids)
        self.w = Sparse(self.owner[self.first], self.near[self.first], self.weight, n)
        self.back = Sparse(self.near[self.first], self.owner[self.first], self.weight, n)
        self.s = Sparse(np.concatenate([self.owner, self.near]), np.concatenate([self.near, self.owner]), None, n)
        return self

    def spread(self, x: np.ndarray) -> np.ndarray:
        """T x."""
        return self.w.times(self.s.times(x)) / self.length[:, None] + self.s.times(self.back.times(x / self.length[:, None]))

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        """Propagated rows of ``nodes`` as columns, not brought to unit length."""
        x = np.zeros((len(self.ids), len(nodes)))
        owner, node, value = self.w.along(np.arange(len(nodes)), nodes, np.ones(len(nodes)))
        np.add.at(x, (node, owner), value)
        return self.spread(x)

    def once(self, nodes: np.ndarray) -> np.ndarray:
        """Squared lengths of the rows after one spreading."""
        return self._squares(len(nodes), [self.s.along(*self.w.along(np.arange(len(nodes)), nodes, np.ones(len(nodes))))])

    def twice(self, nodes: np.ndarray) -> np.ndarray:
        """Squared lengths of the rows after both."""
        owner, node, value = self.w.along(np.arange(len(nodes)), nodes, np.ones(len(nodes)))
        apart, among = self.w.along(owner, node, value / self.length[node]), self.s.along(owner, node, value)
        ends = lambda m, e: int((m.start[e[1] + 1] - m.start[e[1]]).sum())
        if ends(self.s, apart) + ends(self.back, among) > 50 * len(self.ids) * len(nodes):  # hubs: dense products are the fewer
            return np.concatenate([(self.rows(part) ** 2).sum(axis=0) for part in np.array_split(nodes, -(-len(nodes) // BLOCK))])
        owner, node, value = self.back.along(*among)
        return self._squares(len(nodes), [self.s.along(*apart), (owner, node, value / self.length[node])])

    def _squares(self, rows: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        n = len(self.ids)
        dense = sum(np.bincount(owner * n + node, value, minlength=rows * n) for owner, node, value in parts)
        return (dense.reshape(rows, n) ** 2).sum(axis=1)

    def best(self, asked: np.ndarray, k: int, wanted: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, score) of the k wanted nodes that agree best with each query, ties at nine digits by the smaller id."""
        met = self.w.times(self.spread(self.rows(asked)))
        met[~wanted] = 0
        for n, q in enumerate(asked):
            met[q, n] = 0
            found = np.flatnonzero(met[:, n])
            score = met[found, n] / lengths[found] / lengths[q]
            rounded = np.round(score, 9)
            if len(found) > k:
                high = rounded >= np.partition(rounded, -k)[-k]
                found, score, rounded = found[high], score[high], rounded[high]
            take = np.lexsort((found, -rounded))[:k]
            yield np.full(len(take), q), found[take], score[take]


def collected(near: DataFrame, k2: int) -> Graph | None:
    """The graph of (i, j, w, r); None if it is too large for a task or has weights whose products could vanish."""
    if near.count() > MOST_NEIGHBOURS or near.filter(~(F.col("w") >= LEAST_WEIGHT) & (F.col("r") <= k2)).limit(1).count():
        return None
    lists = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("r", "j", "w"))).alias("n"))
    lists = lists.select("i", F.transform("n", lambda e: e["j"]).alias("j"), F.transform(F.slice("n", 1, k2), lambda e: e["w"]).alias("w")).toArrow()
    i = lists.column("i").to_numpy()
    j, w = lists.column("j").combine_chunks(), lists.column("w").combine_chunks()
    count = np.diff(j.offsets.to_numpy())
    node, other = np.repeat(i, count), j.flatten().to_numpy()
    ids = np.unique(np.concatenate([i, other]))
    rank = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
    return Graph(ids, np.searchsorted(ids, node).astype(np.int32), np.searchsorted(ids, other).astype(np.int32), rank < k2, w.flatten().to_numpy())


def _tasks(spark: SparkSession, parts: int, run: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``run`` for each number below ``parts``, each in a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                yield from run(part)

    return spark.range(0, parts, 1, parts).mapInArrow(each, schema)


def _lengths(spark: SparkSession, graph: Graph, parts: int, squares: Callable[[Graph, np.ndarray], np.ndarray]) -> np.ndarray:
    """Lengths of all rows by position, 1 where a row is empty."""

    def run(part: int) -> Iterator[pa.RecordBatch]:
        graph.open()
        mine, step = np.arange(part, len(graph.ids), parts), max(1, DENSE // len(graph.ids))
        for a in range(0, len(mine), step):
            nodes = mine[a : a + step]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.sqrt(squares(graph, nodes)))], names=["node", "length"])

    found = _tasks(spark, parts, run, "node long, length double").toArrow()
    out = np.empty(len(graph.ids))
    out[found.column("node").to_numpy()] = found.column("length").to_numpy()
    return np.where(out > 0, out, 1.0)


def agreement(near: DataFrame, queries: DataFrame, k: int, gallery: DataFrame | None) -> DataFrame | None:
    """(qid, gid, score): the k nodes that agree best with each query; None where ``collected`` gives none."""
    graph = collected(near, k)
    if graph is None:
        return None
    spark = near.sparkSession
    at = lambda df: np.flatnonzero(np.isin(graph.ids, df.select("id").toArrow().column("id").to_numpy()))
    asked, wanted = at(queries), np.ones(len(graph.ids), dtype=bool)
    if gallery is not None:
        wanted[:] = False
        wanted[at(gallery)] = True
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-len(graph.ids) // 256)))
    graph.length = _lengths(spark, graph, parts, Graph.once)
    lengths = _lengths(spark, graph, parts, Graph.twice)

    def run(part: int) -> Iterator[pa.RecordBatch]:
        graph.open()
        mine = asked[part::parts]
        for a in range(0, len(mine), BLOCK):
            for q, g, score in graph.best(mine[a : a + BLOCK], k, wanted, lengths):
                yield pa.RecordBatch.from_arrays([pa.array(graph.ids[q]), pa.array(graph.ids[g]), pa.array(score)], names=["qid", "gid", "score"])

    return _tasks(spark, parts, run, "qid long, gid long, score double")
