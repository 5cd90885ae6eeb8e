"""Searches ask for every fiftieth row and look through all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from geolattice.operators import rerank
from geolattice.plans import retrieval, solving
from tests.test_oracles import FOLDER, duck  # noqa: F401


def test_localize_searches_all_rows(spark, duck, monkeypatch):  # noqa: F811
    seen, search = [], solving.knn.cosine_topk
    monkeypatch.setattr(solving.knn, "cosine_topk", lambda gallery, queries, k: seen.append(gallery.count()) or search(gallery, queries, k))
    solving.localize(spark, FOLDER)
    assert seen == [retrieval._unit(spark, FOLDER).count()]


def test_queries_of_one_table_get_what_each_gets_alone(spark, duck):  # noqa: F811
    unit = retrieval._unit(spark, FOLDER).filter("id BETWEEN 1 AND 60")
    got = rerank.graph_rerank_all(unit, unit.filter(F.col("id") % 20 == 0), 3).collect()
    for q in (20, 60):
        alone = [(r.gid, r["rank"]) for r in rerank.graph_rerank(unit, q, 3).collect()]
        assert sorted(alone) == sorted((r.gid, r["rank"]) for r in got if r.qid == q) and len(alone) == 3
    assert {r.qid for r in got} == {20, 40, 60}
