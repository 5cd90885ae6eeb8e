"""Registered queries of vector retrieval, re-ranking and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import camera
from geolattice.functions.vectors import as_double, l2_normalize
from geolattice.operators import distances, knn, metrics, rerank
from geolattice.scratch import staged

#: Searches take as queries every vector whose id is divisible by this.
EVERY = 50
K = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.normalized(_vectors(spark, sf_dir), "vec_id", "embedding")


def l2_normalize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).select("vec_id", l2_normalize(as_double(F.col("embedding"))).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    unit = _unit(spark, sf_dir)
    return knn.cosine_topk(unit, unit.filter(F.col("id") % EVERY == 0), k)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, K).select("qid", "gid", "rank", F.round("score", 6).alias("score"))


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.neighbour_graph(_unit(spark, sf_dir), K).select("i", "j", F.round("w", 6).alias("w"), "r")


def symmetrize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = staged(rerank.neighbour_graph(_unit(spark, sf_dir), K), "neighbours")
    return rerank.symmetrize(near.select("i", F.col("j").alias("f"), F.lit(1.0).alias("v")))


def graph_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with id 0 asks; all others are the gallery."""
    return rerank.graph_rerank(_unit(spark, sf_dir), 0, K).select("gid", "rank", F.round("score", 6).alias("score"))


def shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking with k = 1: the plain number of shared nearest neighbours."""
    return rerank.graph_rerank(_unit(spark, sf_dir), 0, 1).select("gid", "rank", F.round("score", 6).alias("score"))


def _rerank_every(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    unit = _unit(spark, sf_dir)
    return rerank.graph_rerank_all(unit, unit.filter(F.col("id") % EVERY == 0), k).select("qid", "gid", "rank", F.round("score", 6).alias("score"))


def graph_rerank_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asks; all others are its gallery."""
    return _rerank_every(spark, sf_dir, K)


def shared_neighbours_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rerank_every(spark, sf_dir, 1)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    found = _search(spark, sf_dir, K)
    mine = labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    other = labels.select(F.col("vec_id").alias("gid"), F.col("label").alias("gl"))
    return found.join(mine, "qid").join(other, "gid").select("qid", "gid", "rank", F.when(F.col("ql") == F.col("gl"), 1).otherwise(0).alias("rel"))


def map_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.map_at_k(_ranked(spark, sf_dir), K).select("qid", F.round("ap", 6).alias("ap"))


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = metrics.map_at_k(_ranked(spark, sf_dir), K)
    return ap.agg(F.round(F.avg("ap"), 6).alias("mean"), F.round(F.median("ap"), 6).alias("median"), F.round(F.stddev_pop("ap"), 6).alias("std"))


def cmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cmc(_ranked(spark, sf_dir), (1, 5, 10)).select("cut", F.round("share", 6).alias("share"))


def ap_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same label and another camera (id modulo 4) is good; same label and camera is junk."""
    ranked = _ranked(spark, sf_dir)
    same = F.col("qid") % 4 == F.col("gid") % 4
    marked = ranked.select("qid", "rank", F.when((F.col("rel") == 1) & ~same, 1).otherwise(0).alias("good"), F.when((F.col("rel") == 1) & same, 1).otherwise(0).alias("junk"))
    return metrics.average_precision_without_junk(marked).select("qid", F.round("ap", 6).alias("ap"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins between the smallest and the largest price; the last bin is closed."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_retailprice")
    ends = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    cell = F.least(F.floor((F.col("p_retailprice") - F.col("lo")) * 10 / (F.col("hi") - F.col("lo"))), F.lit(9)).cast("int")
    return part.join(F.broadcast(ends)).groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))


def descriptor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def pairwise_squared_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of each query to its nearest rows, from |x|^2 + |y|^2 - 2xy on unit vectors."""
    return _search(spark, sf_dir, K).select("qid", "gid", F.round(2 - 2 * F.col("score"), 6).alias("d2"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): vectors of three different lengths."""
    scaled = F.transform("v", lambda x: x * (1 + F.col("id") % 3))
    return knn.raw_vectors(_vectors(spark, sf_dir), "vec_id", "embedding").select("id", scaled.alias("v"))


def _measured(spark: SparkSession, sf_dir: str, measure) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return distances.pairwise(raw.filter(F.col("id") % EVERY == 0), raw, measure).select("qid", "gid", (F.round("d", 6) + 0.0).alias("d"))


def squared_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances of every fiftieth raw vector to all, itself included."""
    return _measured(spark, sf_dir, distances.squared)


def raw_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, distances.dot)


def graph_rerank_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranking over the graph of inner products of raw vectors."""
    raw = _raw(spark, sf_dir)
    return rerank.graph_rerank_all(raw, raw.filter(F.col("id") % EVERY == 0), 5).select("qid", "gid", "rank", F.round("score", 6).alias("score"))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r, c): cameras on a grid, turned by multiples of 40 degrees."""
    v = F.col("vec_id")
    return _vectors(spark, sf_dir).select(v.alias("id"), camera.rotation_y((v % 9 * 40).cast("double")).alias("r"), F.array(*[x.cast("double") for x in (v * 7 % 101, v % 7, v * 13 % 89)]).alias("c"))


def camera_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _views(spark, sf_dir).withColumnRenamed("r", "v")
    return distances.pairwise(views.filter(F.col("id") % EVERY == 0), views, distances.angle).select("qid", "gid", F.round("d", 4).alias("deg"))


def _camera_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _views(spark, sf_dir)
    return distances.camera_distances(views.filter(F.col("id") % EVERY == 0), views).filter("qid <> gid")


def camera_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of camera positions; those of views over 90 degrees apart are infinite, shown as -1."""
    return _camera_distances(spark, sf_dir).select("qid", "gid", F.when(F.col("d") == float("inf"), -1.0).otherwise(F.round("d", 6)).alias("d"))


def order_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.order_k(_camera_distances(spark, sf_dir), 23).select("qid", "gid", "rank")


def descriptor_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision at 3 of the most similar rows, the 23 nearest cameras being relevant."""
    nearest = staged(distances.order_k(_camera_distances(spark, sf_dir), 23), "nearest-cameras")
    return metrics.map_at_k(distances.agreement(_search(spark, sf_dir, 3), nearest), 3).select("qid", F.round("ap", 6).alias("ap"))


QUERIES = {
    "l2_normalize": l2_normalize_all,
    "cosine_topk": cosine_topk,
    "knn_graph": knn_graph,
    "symmetrize_edges": symmetrize_edges,
    "graph_rerank": graph_rerank,
    "shared_neighbours": shared_neighbours,
    "graph_rerank_every": graph_rerank_every,
    "shared_neighbours_every": shared_neighbours_every,
    "map_at_k": map_at_k,
    "summary_stats": summary_stats,
    "cmc": cmc,
    "ap_junk": ap_junk,
    "score_histogram": score_histogram,
    "descriptor_mean": descriptor_mean,
    "pairwise_squared_distance": pairwise_squared_distance,
    "squared_distances": squared_distances,
    "raw_dot": raw_dot,
    "graph_rerank_raw": graph_rerank_raw,
    "camera_angles": camera_angles,
    "camera_distances": camera_distances,
    "order_k": order_k,
    "descriptor_agreement": descriptor_agreement,
}

_UNIT = """
raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM raw WHERE list_inner_product(e, e) > 0)
"""
_TOPK = f"""
{_UNIT},
pairs AS (SELECT q.id AS qid, g.id AS gid, list_inner_product(q.v, g.v) AS score FROM u q, u g WHERE q.id % {EVERY} = 0 AND q.id <> g.id),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, gid) AS INTEGER) AS rank FROM pairs) WHERE rank <= {K})
"""
_NEAR = """
nb AS (SELECT * FROM (SELECT a.id AS i, b.id AS j, pow(list_inner_product(a.v, b.v), 2) AS w,
       CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.id) AS INTEGER) AS r FROM u a, u b) WHERE r <= {k1})
"""
_RANKED = """
ranked AS (SELECT t.qid, t.gid, t.rank, CAST(a.label = b.label AS INTEGER) AS rel FROM top t JOIN embeddings a ON a.vec_id = t.qid JOIN embeddings b ON b.vec_id = t.gid)
"""
_AP = f"""
hits AS (SELECT qid, rank, rel, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS h FROM ranked),
ap AS (SELECT qid, sum(rel * h / rank::DOUBLE) / {K} AS ap FROM hits GROUP BY qid)
"""
_SPREAD = """
s{n} AS (SELECT i, f, sum(v) AS v FROM (SELECT i, f, v FROM a{n} UNION ALL SELECT f, i, v FROM a{n}) GROUP BY i, f),
p{n} AS (SELECT nb.i, s.f, sum(nb.w * s.v) AS v FROM nb JOIN s{n} s ON s.i = nb.j WHERE nb.r <= {k2} GROUP BY nb.i, s.f),
a{m} AS (SELECT i, f, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS v FROM p{n})
"""

_RAW = "u AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS v FROM embeddings)"
_VIEWS = f"""
c AS (SELECT vec_id AS id, vec_id % 9 * 40 AS turn, vec_id * 7 % 101 AS x, vec_id % 7 AS y, vec_id * 13 % 89 AS z FROM embeddings),
p AS (SELECT q.id AS qid, g.id AS gid, least(abs(q.turn - g.turn), 360 - abs(q.turn - g.turn)) AS deg, sqrt((pow(q.x - g.x, 2) + pow(q.y - g.y, 2) + pow(q.z - g.z, 2))::DOUBLE) AS far FROM c q, c g WHERE q.id % {EVERY} = 0),
d AS (SELECT qid, gid, CASE WHEN deg > 90 THEN 'inf'::DOUBLE ELSE far END AS d FROM p WHERE qid <> gid),
o AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, gid) AS INTEGER) AS rank FROM d) WHERE rank <= 23)"""

ORACLES = {
    "squared_distances": f"WITH {_RAW} SELECT q.id AS qid, g.id AS gid, round(list_sum(list_transform(list_zip(q.v, g.v), lambda x: pow(x[1] - x[2], 2))), 6) + 0e0 AS d FROM u q, u g WHERE q.id % {EVERY} = 0",
    "raw_dot": f"WITH {_RAW} SELECT q.id AS qid, g.id AS gid, round(list_inner_product(q.v, g.v), 6) + 0e0 AS d FROM u q, u g WHERE q.id % {EVERY} = 0",
    "graph_rerank_raw": f"""WITH {_RAW}, {_NEAR.format(k1=15)}, a0 AS (SELECT i, j AS f, 1e0 AS v FROM nb), {_SPREAD.format(n=0, m=1, k2=5)}, {_SPREAD.format(n=1, m=2, k2=5)},
sc AS (SELECT q.i AS qid, g.i AS gid, sum(q.v * g.v) AS score FROM a2 q JOIN a2 g ON q.f = g.f WHERE q.i % {EVERY} = 0 AND g.i <> q.i GROUP BY q.i, g.i)
SELECT qid, gid, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, gid) AS r FROM sc) WHERE r <= 5""",
    "camera_angles": f"WITH {_VIEWS} SELECT qid, gid, deg::DOUBLE AS deg FROM p",
    "camera_distances": f"WITH {_VIEWS} SELECT qid, gid, CASE WHEN isinf(d) THEN -1e0 ELSE round(d, 6) END AS d FROM d",
    "order_k": f"WITH {_VIEWS} SELECT qid, gid, rank FROM o",
    "descriptor_agreement": f"""WITH {_VIEWS}, {_TOPK}, rel AS (SELECT t.qid, t.rank, CAST(o.gid IS NOT NULL AS INTEGER) AS rel FROM top t LEFT JOIN o ON o.qid = t.qid AND o.gid = t.gid WHERE t.rank <= 3),
h AS (SELECT qid, rank, rel, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS h FROM rel) SELECT qid, round(sum(rel * h / rank::DOUBLE) / 3, 6) AS ap FROM h GROUP BY qid""",
    "l2_normalize": f"WITH {_UNIT} SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i], 6) AS x FROM u, range(1, 65) t(i) WHERE i <= len(v)",
    "cosine_topk": f"WITH {_TOPK} SELECT qid, gid, rank, round(score, 6) AS score FROM top",
    "knn_graph": f"WITH {_UNIT}, {_NEAR.format(k1=K)} SELECT i, j, round(w, 6) AS w, r FROM nb",
    "symmetrize_edges": f"WITH {_UNIT}, {_NEAR.format(k1=K)} SELECT i, f, sum(v)::DOUBLE AS v FROM (SELECT i, j AS f, 1 AS v FROM nb UNION ALL SELECT j, i, 1 FROM nb) GROUP BY i, f",
    "graph_rerank": f"""WITH {_UNIT}, {_NEAR.format(k1=3 * K)}, a0 AS (SELECT i, j AS f, 1e0 AS v FROM nb), {_SPREAD.format(n=0, m=1, k2=K)}, {_SPREAD.format(n=1, m=2, k2=K)},
sc AS (SELECT g.i AS gid, sum(q.v * g.v) AS score FROM a2 q JOIN a2 g ON q.f = g.f WHERE q.i = 0 AND g.i <> 0 GROUP BY g.i)
SELECT gid, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, gid) AS INTEGER) AS rank, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, gid LIMIT {K}""",
    "shared_neighbours": f"""WITH {_UNIT}, {_NEAR.format(k1=3)},
sc AS (SELECT g.i AS gid, count(*)::DOUBLE AS score FROM nb q JOIN nb g ON q.j = g.j WHERE q.i = 0 AND g.i <> 0 GROUP BY g.i)
SELECT gid, CAST(1 AS INTEGER) AS rank, round(score, 6) AS score FROM sc ORDER BY score DESC, gid LIMIT 1""",
    "graph_rerank_every": f"""WITH {_UNIT}, {_NEAR.format(k1=3 * K)}, a0 AS (SELECT i, j AS f, 1e0 AS v FROM nb), {_SPREAD.format(n=0, m=1, k2=K)}, {_SPREAD.format(n=1, m=2, k2=K)},
sc AS (SELECT q.i AS qid, g.i AS gid, sum(q.v * g.v) AS score FROM a2 q JOIN a2 g ON q.f = g.f WHERE q.i % {EVERY} = 0 AND g.i <> q.i GROUP BY q.i, g.i)
SELECT qid, gid, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, gid) AS r FROM sc) WHERE r <= {K}""",
    "shared_neighbours_every": f"""WITH {_UNIT}, {_NEAR.format(k1=3)},
sc AS (SELECT q.i AS qid, g.i AS gid, count(*)::DOUBLE AS score FROM nb q JOIN nb g ON q.j = g.j WHERE q.i % {EVERY} = 0 AND g.i <> q.i GROUP BY q.i, g.i)
SELECT qid, gid, CAST(1 AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS r FROM sc) WHERE r = 1""",
    "map_at_k": f"WITH {_TOPK}, {_RANKED}, {_AP} SELECT qid, round(ap, 6) AS ap FROM ap",
    "summary_stats": f"WITH {_TOPK}, {_RANKED}, {_AP} SELECT round(avg(ap), 6) AS mean, round(median(ap), 6) AS median, round(stddev_pop(ap), 6) AS std FROM ap",
    "cmc": f"""WITH {_TOPK}, {_RANKED}, f AS (SELECT qid, min(CASE WHEN rel = 1 THEN rank END) AS first FROM ranked GROUP BY qid)
SELECT cut, round(avg(CASE WHEN first <= cut THEN 1e0 ELSE 0e0 END), 6) AS share FROM f, (VALUES (1), (5), (10)) c(cut) GROUP BY cut""",
    "ap_junk": f"""WITH {_TOPK}, {_RANKED},
kept AS (SELECT qid, rank, rel, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS pos FROM ranked WHERE NOT (rel = 1 AND qid % 4 = gid % 4)),
good AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n, count(*) OVER (PARTITION BY qid) AS m FROM kept WHERE rel = 1)
SELECT qid, round(sum((n / (pos + 1)::DOUBLE + CASE WHEN pos = 0 THEN 1 ELSE (n - 1) / pos::DOUBLE END) / 2 / m), 6) AS ap FROM good GROUP BY qid""",
    "score_histogram": """WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT CAST(least(floor((p_retailprice - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS n FROM part, e GROUP BY 1""",
    "descriptor_mean": "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i",
    "pairwise_squared_distance": f"WITH {_TOPK} SELECT qid, gid, round(2 - 2 * score, 6) AS d2 FROM top",
}
