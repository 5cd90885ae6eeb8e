"""Re-ranking by products against the joins that it stands for, and what both leave in the shared folder."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice import scratch
from geolattice.operators import knn, rerank, spread


def _nodes(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6))
    if kind == "copies":
        v[10:60] = v[10]
    if kind == "raw":
        v *= 1 + np.arange(90)[:, None] % 3
    if kind == "orthogonal":
        v = np.eye(90)
    rows = [(int(7 * n), x.tolist()) for n, x in enumerate(v)]
    raw = spark.createDataFrame(rows, "id long, v array<double>")
    return raw if kind == "raw" else knn.normalized(raw, "id", "v")


def _ranked(df):
    return sorted((r.qid, r["rank"], r.gid, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["plain", "copies", "raw", "orthogonal"])
@pytest.mark.parametrize("some", [False, True])
def test_products_give_what_joins_give(spark, monkeypatch, kind, some):
    nodes = _nodes(spark, kind)
    queries, gallery = nodes.filter("id % 35 = 0"), nodes.filter("id % 2 = 0") if some else None
    monkeypatch.setattr(spread, "BLOCK", 5)
    got = _ranked(rerank.graph_rerank_all(nodes, queries, 4, gallery))
    monkeypatch.setattr(spread, "MOST_NEIGHBOURS", 0)
    assert got == _ranked(rerank.graph_rerank_all(nodes, queries, 4, gallery)) and len({q for q, *_ in got}) == 18


def test_only_the_neighbours_are_written(spark, monkeypatch, tmp_path):
    nodes = _nodes(spark, "plain")
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    rerank.graph_rerank_all(nodes, nodes.filter(F.col("id") % 35 == 0), 4).collect()
    assert [name.split("-")[0] for name in os.listdir(tmp_path / "geolattice")] == ["neighbours"]


def test_lengths_by_entries_and_by_dense_products_agree():
    rng = np.random.default_rng(2)
    n, k1 = 40, 6
    near = np.array([rng.choice(n, k1, replace=False) for _ in range(n)])
    first = np.tile(np.arange(k1) < 2, n)
    graph = spread.Graph(np.arange(n), np.repeat(np.arange(n), k1), near.reshape(-1), first, rng.random(2 * n)).open()
    graph.length = np.sqrt(graph.once(np.arange(n)))
    assert np.allclose(graph.twice(np.arange(n)), (graph.rows(np.arange(n)) ** 2).sum(axis=0), rtol=1e-12, atol=0)


@pytest.mark.parametrize("keep_self", [False, True])
def test_best_by_threshold_is_the_full_order(keep_self):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 2)), 1)  # many ties
    vectors[7] = np.nan
    best = knn.Best(np.arange(0, 300, 50), vectors[::50], 5, keep_self)
    for a, b in ((0, 3), (3, 4), (4, 120), (120, 121), (121, 300)):
        best.see(np.arange(a, b), vectors[a:b])
    for q, found in zip(range(0, 300, 50), best.other):
        score = vectors @ vectors[q]
        order = sorted((n for n in range(300) if n != 7 and (keep_self or n != q)), key=lambda n: (-np.round(score[n], 9), n))
        assert list(found) == order[:5]
