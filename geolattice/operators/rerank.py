"""Graph re-ranking of a retrieved list by agreement of neighbourhoods.

The graph has the query and every gallery row as nodes and the k1 nearest neighbours as
edges. Twice, the edge table is made symmetric, spread over each node's k2 nearest neighbours
with squared similarities as weights, and its rows are normalised. The rows of the query and
of each gallery row are then compared. A graph that is counted to fit a task gives the scores
by products (``spread``), and none of its propagated rows is written out. For larger graphs
every stage is an equi-join and a sum, written out before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolattice.operators import spread
from geolattice.operators.knn import cosine_topk
from geolattice.scratch import staged


def neighbour_graph(nodes: DataFrame, k1: int) -> DataFrame:
    """(i, j, w, r): the k1 nearest nodes of each node, itself included, with squared similarity and rank."""
    found = cosine_topk(nodes, nodes, k1, keep_self=True)
    return found.select(F.col("qid").alias("i"), F.col("gid").alias("j"), (F.col("score") * F.col("score")).alias("w"), F.col("rank").alias("r"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """(i, f, v): each edge table entry added to its mirror image."""
    return edges.select("i", "f", "v").union(edges.select(F.col("f").alias("i"), F.col("i").alias("f"), "v")).groupBy("i", "f").agg(F.sum("v").alias("v"))


def propagate(near: DataFrame, rows: DataFrame, k2: int) -> DataFrame:
    """(i, f, v): for each node the weighted sum of its k2 nearest neighbours' rows, brought to unit length."""
    summed = near.filter(F.col("r") <= k2).join(rows.withColumnRenamed("i", "j"), "j").groupBy("i", "f").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("i")))
    return summed.select("i", "f", (F.col("v") / length).alias("v"))


def _propagated(near: DataFrame, k: int) -> DataFrame:
    """(i, f, v): every node's row after both spreadings."""
    rows = near.select("i", F.col("j").alias("f"), F.lit(1.0).alias("v"))
    if k != 1:
        for step in range(2):
            rows = staged(propagate(near, staged(symmetrize(rows), f"symmetric-{step}"), k), f"propagated-{step}")
    return rows


def graph_rerank(nodes: DataFrame, query_id: int, k: int) -> DataFrame:
    """(gid, rank, score): the k gallery rows that agree best with the query; k1 = 3k, k2 = k."""
    return graph_rerank_all(nodes, nodes.filter(F.col("id") == query_id), k).select("gid", "rank", "score")


def graph_rerank_all(nodes: DataFrame, queries: DataFrame, k: int, gallery: DataFrame | None = None) -> DataFrame:
    """(qid, gid, rank, score): for each id of ``queries`` the k other nodes that agree best with it, from one graph.

    With ``gallery`` only its ids are found.
    """
    near = staged(neighbour_graph(nodes, 3 * k), "neighbours")
    scores = spread.agreement(near, queries, k, gallery) if k != 1 else None
    if scores is None:
        scores = _agreement_by_joins(near, queries, k, gallery)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "gid")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "gid", "rank", "score")


def _agreement_by_joins(near: DataFrame, queries: DataFrame, k: int, gallery: DataFrame | None) -> DataFrame:
    """(qid, gid, score): each query and all nodes whose rows meet its row."""
    rows = _propagated(near, k)
    mine = rows.join(queries.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("i").alias("qid"), "f", F.col("v").alias("q"))
    others = rows if gallery is None else rows.join(gallery.select(F.col("id").alias("i")), "i", "left_semi")
    return others.join(mine, "f").filter("i <> qid").groupBy("qid", F.col("i").alias("gid")).agg(F.sum(F.col("q") * F.col("v")).alias("score"))


def retrieve(gallery: DataFrame, queries: DataFrame, k: int, rerank: bool = False) -> DataFrame:
    """(query_id, ref_rank, ref_id): the references of each query from rank 0, by inner product or re-ranked over the graph of both sides.

    Both sides are (id, v); a query's own id is never found. With ``rerank`` the graph holds
    the queries and the gallery, an id on both sides once.
    """
    if rerank:
        found = graph_rerank_all(gallery.union(queries.join(gallery, "id", "left_anti").select("id", "v")), queries, k, gallery)
    else:
        found = cosine_topk(gallery, queries, k)
    return found.select(F.col("qid").alias("query_id"), (F.col("rank") - 1).alias("ref_rank"), F.col("gid").alias("ref_id"))
