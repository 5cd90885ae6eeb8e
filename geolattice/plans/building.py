"""Registered queries of dataset building, set operations, pooling and keypoint algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import text
from geolattice.operators import datasets, geodata, matching, pooling, streets
from geolattice.plans.cameras import _vincenty
from geolattice.plans.fixtures import CAMERAS, cameras


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names with their ids unpadded, in natural order."""
    s = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("img"), F.col("s_suppkey"), F.lit("_"), F.col("s_nationkey"), F.lit(".jpg")).alias("path"))
    keyed = s.withColumn("key", text.natural_key(F.col("path")))
    return datasets.numbered(keyed, "key").select("path", F.col("_n").alias("pos"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("seq/img_g"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, ".jpg").otherwise(".png")).alias("path"))
    return s.select("s_suppkey", text.path_to_name(text.without_suffix(F.col("path"))).alias("name"), text.stripped_suffix(F.col("path")).alias("legacy"), text.starts_with_pattern(F.col("path"), "seq/img_g1").alias("hit"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").filter(F.lower("event_type") != "error").select("user_id", "event_id", "event_type")
    return datasets.keep_first(e, "user_id", "event_id")


def heading_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.headings(cameras(spark, sf_dir).select("entry_id"), 7)


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.chunks(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 300)


def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.every_nth(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 1000)


def complement_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of a high price; the keys of some orders are NULL and exclude nobody."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    dear = o.filter("o_totalprice > 400000").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("key"))
    return c.select("c_custkey").join(dear, F.col("c_custkey") == F.col("key"), "left_anti")


def intersect_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    return c.select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def union_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("nation")).unionAll(s.select(F.col("s_nationkey").alias("nation"))).groupBy("nation").agg(F.count("*").alias("n"))


def distinct_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cameras(spark, sf_dir).select(F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng")).distinct()
    return d.agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))


def last_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = cameras(spark, sf_dir).select("entry_id", "alt", "azn")
    new = old.filter("entry_id % 3 = 0").select("entry_id", (F.col("alt") + 1000).alias("alt"))
    return datasets.merged(old, new, "entry_id")


def edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cameras(spark, sf_dir).select("entry_id", "lat", "lng")
    edges = n.filter("entry_id % 25 < 24").select(F.col("entry_id").alias("u"), (F.col("entry_id") + 1).alias("v"))
    a, b = (n.select(F.col("entry_id").alias(k), F.round("lat", 6).alias(f"{k}_lat"), F.round("lng", 6).alias(f"{k}_lng")) for k in ("u", "v"))
    return edges.join(a, "u").join(b, "v")


def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, channel, cell, y, x, value): embeddings as 8 channels on a grid of 4 by 2 cells."""
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("p", "v"))
    cell = F.floor(F.col("p") / 8)
    return e.select("image", (F.col("p") % 8).cast("long").alias("channel"), cell.alias("cell"), F.floor(cell / 4).alias("y"), (cell % 4).alias("x"), F.col("v").cast("double").alias("value"))


def _pooled(df: DataFrame) -> DataFrame:
    return df.select("image", "channel", (F.round("x", 6) + 0.0).alias("x"))


def mac_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(pooling.mac(_features(spark, sf_dir)))


def spoc_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(pooling.spoc(_features(spark, sf_dir)))


def gem_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(pooling.gem(_features(spark, sf_dir)))


def rmac_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(pooling.rmac(_features(spark, sf_dir), 4, 2, 1))


def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _features(spark, sf_dir).select("image", F.col("cell").alias("token"), ((F.col("image") * 7 + F.col("cell") * 3) % 5 / 2.0).alias("score"), "channel", "value")
    return _pooled(pooling.attention_pool(t))


def _centroids(spark: SparkSession) -> DataFrame:
    return spark.range(32).selectExpr("id div 8 AS k", "id % 8 AS channel", "((id * 5) % 7 - 3) / 10D AS value")


def netvlad_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.netvlad(_features(spark, sf_dir), _centroids(spark), 2.0).select("image", "k", "channel", (F.round("x", 6) + 0.0).alias("x"))


def batch_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem").select((F.col("l_linenumber")).alias("channel"), (F.col("l_quantity") - 25).alias("value"))
    m = pooling.batch_moments(line)
    return m.select("channel", "n", *[F.round(c, 6).alias(c) for c in ("mean", "var", "unbiased", "inv_std")])


def batch_moments_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that adds eps to the variance."""
    line = _read(spark, sf_dir, "lineitem").select((F.col("l_linenumber")).alias("channel"), (F.col("l_quantity") - 25).alias("value"))
    return pooling.batch_moments(line, eps=0.5, added=True).select("channel", "n", F.round("inv_std", 6).alias("inv_std"))


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return pooling.ema(e, "event_type", "event_id", 0.9).select("event_type", F.round("ema", 6).alias("ema"))


def clip_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _read(spark, sf_dir, "part").groupBy((F.floor(F.col("p_retailprice")) % 256).alias("level")).agg(F.count("*").alias("n"))
    return pooling.clip_range(levels, 2.0).select("lo", "hi", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def positional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sine on even and cosine on odd columns of p / 10000^(2 floor(i/2) / d)."""
    t = spark.range(50).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    angle = F.col("p") / F.pow(F.lit(10000.0), 2 * F.floor(F.col("i") / 2) / 16.0)
    return t.select("p", "i", F.round(F.when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6).alias("x"))


def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    r = text.ramp(F.col("s_suppkey") % 13 / 10.0 - 0.1)
    return s.select("s_suppkey", F.round(r["r"], 6).alias("r"), F.round(r["g"], 6).alias("g"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, score): 48 scored pixels of a 24 by 24 image for every vector."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long"))).alias("k"))
    return e.selectExpr("vec_id AS image", "(k * 29 + vec_id * 3) % 24 AS y", "(k * 17 + vec_id * 5) % 24 AS x", "((k * 37 + vec_id * 11) % 101) / 101D AS score")


_POINTS = "points AS (SELECT vec_id AS image, (k * 29 + vec_id * 3) % 24 AS y, (k * 17 + vec_id * 5) % 24 AS x, ((k * 37 + vec_id * 11) % 101) / 101e0 AS score FROM embeddings, range(0, 48) g(k))"


def suppressed_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suppress(_points(spark, sf_dir), 4).withColumn("score", F.round("score", 6))


def topk_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.top_keypoints(matching.inside_border(_points(spark, sf_dir), 4, 24, 24), 10).withColumn("score", F.round("score", 6))


def normalized_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = matching.normalized_keypoints(_points(spark, sf_dir), 64.0, 48.0)
    return p.select("image", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), F.round("score", 6).alias("score"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, i, j, score): a 6 by 5 score table for every vector."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("k"))
    return e.selectExpr("vec_id AS pair", "k div 5 AS i", "k % 5 AS j", "((k * 31 + vec_id * 7) % 61) / 20D AS score")


_SCORES = "scores AS (SELECT vec_id AS pair, k // 5 AS i, k % 5 AS j, ((k * 31 + vec_id * 7) % 61) / 20e0 AS score FROM embeddings, range(0, 30) g(k))"


def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mutual_matches(_scores(spark, sf_dir), 0.2).withColumn("score", F.round("score", 6))


def sinkhorn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.sinkhorn(_scores(spark, sf_dir), 1.0, 3).select("pair", "i", "j", F.round("z", 6).alias("z"))


QUERIES = {
    f.__name__: f
    for f in (
        natural_sort, path_names, dedupe_first, heading_explode, chunk_rows, every_nth, complement_set, intersect_set, union_append, distinct_coordinates, last_wins_merge, edge_endpoints,
        json_metadata, mac_pool, spoc_pool, gem_pool, rmac_pool, attention_pool, netvlad_pool, batch_moments, batch_moments_added, ema, clip_histogram, positional_table, colour_ramp,
        suppressed_keypoints, topk_keypoints, normalized_keypoints, mutual_nn, sinkhorn,
    )
}

_FEATURES = "f AS (SELECT vec_id AS image, (i - 1) % 8 AS channel, (i - 1) // 8 AS cell, (i - 1) // 32 AS y, (i - 1) // 8 % 4 AS x, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) g(i))"


def _sinkhorn_sql(rounds: int) -> str:
    out = [
        _SCORES,
        """t AS (SELECT pair, i, j, score::DOUBLE AS s, CASE WHEN i < 0 THEN ln(5) - ln(11) ELSE -ln(11) END AS mu, CASE WHEN j < 0 THEN ln(6) - ln(11) ELSE -ln(11) END AS nu FROM (
 SELECT pair, i, j, score FROM scores UNION ALL SELECT DISTINCT pair, i, -1, 1e0 FROM scores UNION ALL SELECT DISTINCT pair, -1, j, 1e0 FROM scores UNION ALL SELECT DISTINCT pair, -1, -1, 1e0 FROM scores))""",
        "v0 AS (SELECT DISTINCT pair, j, 0e0 AS v FROM t)",
    ]
    for r in range(rounds):
        out.append(f"u{r + 1} AS (SELECT pair, i, any_value(mu) - ln(sum(exp(s + v))) AS u FROM t JOIN v{r} USING (pair, j) GROUP BY pair, i)")
        out.append(f"v{r + 1} AS (SELECT pair, j, any_value(nu) - ln(sum(exp(s + u))) AS v FROM t JOIN u{r + 1} USING (pair, i) GROUP BY pair, j)")
    return f"WITH {', '.join(out)} SELECT pair, i, j, round(s + u + v + ln(11), 6) AS z FROM t JOIN u{rounds} USING (pair, i) JOIN v{rounds} USING (pair, j)"


#: Regions of a map of 4 by 2 at one level as (id, top, left, height, width).
_RMAC_REGIONS = "r AS (SELECT * FROM (VALUES (0, 0, 0, 2, 4), (1, 0, 0, 2, 2), (2, 0, 1, 2, 2), (3, 0, 2, 2, 2)) v(id, t, l, h, w))"

ORACLES = {
    "natural_sort": "SELECT 'img' || s_suppkey || '_' || s_nationkey || '.jpg' AS path, row_number() OVER (ORDER BY s_suppkey, s_nationkey) - 1 AS pos FROM supplier",
    "path_names": """WITH s AS (SELECT s_suppkey, 'seq/img_g' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS path FROM supplier)
SELECT s_suppkey, replace(left(path, length(path) - 4), '/', '_') AS name, rtrim(rtrim(path, '.jpg'), '.png') AS legacy, starts_with(path, 'seq/img_g1') AS hit FROM s""",
    "dedupe_first": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE lower(event_type) <> 'error') WHERE n = 1",
    "heading_explode": "SELECT vec_id AS entry_id, CAST(h AS INTEGER) AS heading FROM embeddings, range(0, 360, 51) g(h)",
    "chunk_rows": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 300 AS chunk, (row_number() OVER (ORDER BY o_orderkey) - 1) % 300 AS pos FROM orders",
    "every_nth": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 0 AND n < 7000",
    "complement_set": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000 AND CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END = c_custkey)",
    "intersect_set": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "union_append": "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation",
    "distinct_coordinates": f"SELECT count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM (SELECT DISTINCT round(lat, 3) AS lat, round(lng, 3) AS lng FROM ({CAMERAS}))",
    "last_wins_merge": f"SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN alt + 1000 ELSE alt END AS alt, azn FROM ({CAMERAS})",
    "edge_endpoints": f"WITH n AS (SELECT entry_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ({CAMERAS})) SELECT a.entry_id AS u, b.entry_id AS v, a.lat AS u_lat, a.lng AS u_lng, b.lat AS v_lat, b.lng AS v_lng FROM n a JOIN n b ON b.entry_id = a.entry_id + 1 WHERE a.entry_id % 25 < 24",
    "json_metadata": "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events",
    "mac_pool": f"WITH {_FEATURES} SELECT image, channel, round(max(value), 6) + 0e0 AS x FROM f GROUP BY image, channel",
    "spoc_pool": f"WITH {_FEATURES} SELECT image, channel, round(avg(value), 6) + 0e0 AS x FROM f GROUP BY image, channel",
    "gem_pool": f"WITH {_FEATURES} SELECT image, channel, round(pow(avg(pow(greatest(value, 1e-6), 3)), 1 / 3e0), 6) + 0e0 AS x FROM f GROUP BY image, channel",
    "rmac_pool": f"""WITH {_FEATURES}, {_RMAC_REGIONS}, m AS (SELECT image, id, channel, max(value) AS m FROM f JOIN r ON y >= t AND y < t + h AND x >= l AND x < l + w GROUP BY image, id, channel),
u AS (SELECT image, channel, m / (sqrt(sum(m * m) OVER (PARTITION BY image, id)) + 1e-6) AS u FROM m) SELECT image, channel, round(sum(u), 6) + 0e0 AS x FROM u GROUP BY image, channel""",
    "attention_pool": f"WITH {_FEATURES}, w AS (SELECT *, exp(((image * 7 + cell * 3) % 5) / 2e0) AS w FROM f) SELECT image, channel, round(sum(w * value) / sum(w), 6) + 0e0 AS x FROM w GROUP BY image, channel",
    "netvlad_pool": f"""WITH {_FEATURES}, c AS (SELECT i // 8 AS k, i % 8 AS channel, ((i * 5) % 7 - 3) / 10e0 AS c FROM range(0, 32) g(i)),
z AS (SELECT image, cell, k, exp(sum(4 * value * c - 2 * c * c)) AS e FROM f JOIN c USING (channel) GROUP BY image, cell, k), a AS (SELECT image, cell, k, e / sum(e) OVER (PARTITION BY image, cell) AS a FROM z),
s AS (SELECT image, k, channel, sum(a * (value - c)) AS v FROM f JOIN c USING (channel) JOIN a USING (image, cell, k) GROUP BY image, k, channel),
n AS (SELECT image, k, channel, v / sqrt(sum(v * v) OVER (PARTITION BY image, k)) AS v FROM s) SELECT image, k, channel, round(v / sqrt(sum(v * v) OVER (PARTITION BY image)), 6) + 0e0 AS x FROM n""",
    "batch_moments": """SELECT l_linenumber AS channel, count(*) AS n, round(avg(l_quantity - 25), 6) AS mean, round(var_pop(l_quantity - 25), 6) AS var, round(var_samp(l_quantity - 25), 6) AS unbiased,
round(1 / sqrt(greatest(var_pop(l_quantity - 25), 1e-5)), 6) AS inv_std FROM lineitem GROUP BY l_linenumber""",
    "batch_moments_added": "SELECT l_linenumber AS channel, count(*) AS n, round(1 / sqrt(var_pop(l_quantity - 25) + 0.5e0), 6) AS inv_std FROM lineitem GROUP BY l_linenumber",
    "ema": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(pow(0.9e0, age) * CASE WHEN age = n - 1 THEN 1e0 ELSE 0.1e0 END * value), 6) AS ema FROM o GROUP BY event_type""",
    "clip_histogram": """WITH h AS (SELECT CAST(floor(p_retailprice) AS BIGINT) % 256 AS level, count(*) AS n FROM part GROUP BY 1), c AS (SELECT level, sum(n) OVER (ORDER BY level) AS cum, sum(n) OVER () AS total FROM h),
e AS (SELECT min(CASE WHEN cum >= total * 0.01e0 THEN level END) AS lo, max(CASE WHEN cum < total - total * 0.01e0 THEN level END) AS hi FROM c)
SELECT lo, hi, round(255e0 / (hi - lo), 6) AS alpha, round(-lo * (255e0 / (hi - lo)), 6) AS beta FROM e""",
    "positional_table": """SELECT p, CAST(i AS INTEGER) AS i, round(CASE WHEN i % 2 = 0 THEN sin(p / pow(10000e0, 2 * (i // 2) / 16e0)) ELSE cos(p / pow(10000e0, 2 * (i // 2) / 16e0)) END, 6) AS x FROM range(0, 50) a(p), range(0, 16) b(i)""",
    "colour_ramp": """WITH t AS (SELECT s_suppkey, greatest(0e0, least(1e0, s_suppkey % 13 / 10e0 - 0.1e0)) * 2 AS t FROM supplier) SELECT s_suppkey, round(greatest(0e0, least(1e0, 2 - t)), 6) AS r, round(least(1e0, t), 6) AS g FROM t""",
    "suppressed_keypoints": f"WITH {_POINTS} SELECT DISTINCT image, y, x, round(score, 6) AS score FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.image = p.image AND abs(o.y - p.y) <= 4 AND abs(o.x - p.x) <= 4 AND o.score > p.score)",
    "topk_keypoints": f"WITH {_POINTS} SELECT image, y, x, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, y, x) AS n FROM points WHERE y >= 4 AND y < 20 AND x >= 4 AND x < 20) WHERE n <= 10",
    "normalized_keypoints": f"WITH {_POINTS} SELECT image, round((y - 24) / (0.7e0 * 64), 6) AS y, round((x - 32) / (0.7e0 * 64), 6) AS x, round(score, 6) AS score FROM points",
    "mutual_nn": f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY score DESC, j) AS a, row_number() OVER (PARTITION BY pair, j ORDER BY score DESC, i) AS b FROM scores) SELECT pair, i, j, round(score, 6) AS score FROM r WHERE a = 1 AND b = 1 AND score > 0.2",
    "sinkhorn": _sinkhorn_sql(3),
}


# --- streets and geodata --------------------------------------------------------------------


def _street_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of a row joined one after another, and rows joined at their first and last cameras."""
    c = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"))
    along = c.filter("v % 25 < 24").selectExpr("v AS u", "v + 1 AS v")
    across = c.filter("v >= 25 AND (v % 25 = 0 OR v % 25 = 24)").selectExpr("v - 25 AS u", "v AS v")
    return along.union(across)


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices per merged line, by the line's smallest node: rows keep their 25, crossings part them."""
    lines = streets.merge_lines(_street_edges(spark, sf_dir))
    return lines.groupBy("line").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).select("low", "high", "n")


def network_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.within_distance(_street_edges(spark, sf_dir).withColumn("length", F.lit(1.0)), 0, 20.0)


def street_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cameras(spark, sf_dir).select(F.col("entry_id").alias("id"), "lat", "lng")
    return streets.sample_streets(nodes, _street_edges(spark, sf_dir), 30.0, jitter=(1.0, 2.0), seed=3)


def updated_geodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras relative to a fixed anchor: the pose's translation and the base that it refers to."""
    u = geodata.update_geodata(cameras(spark, sf_dir), {"lat": 49.84, "lng": 24.03, "alt": 290.0, "azn": 0.0})
    return u.select("entry_id", F.round(F.get("K", 0), 6).alias("f"), *[(F.round(F.get("E", i), 4) + 0.0).alias(f"t{n}") for n, i in enumerate((3, 7, 11))], "baselat", "basealt")


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(geodata.contrastive_loss(F.col("p_size") / 10.0, (F.col("p_partkey") % 17) / 5.0), 6).alias("loss"))


def joint_contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive against three negatives at once."""
    p = _read(spark, sf_dir, "part")
    others = F.array(*[(F.col("p_partkey") % n) / 5.0 for n in (17, 13, 11)])
    return p.select("p_partkey", F.round(geodata.joint_contrastive_loss(F.col("p_size") / 10.0, others), 6).alias("loss"))


def sampled_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors sampled from the 2 by 4 grids of the embeddings at five points each."""
    grid = _features(spark, sf_dir).select("image", F.col("y").alias("gy"), F.col("x").alias("gx"), "channel", "value")
    points = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    points = points.select("image", (4 + F.col("k") * 2).alias("y"), (4 + F.col("k") * 5).alias("x"))
    return matching.sampled_descriptors(grid, points).select("image", "y", "x", "channel", (F.round("v", 6) + 0.0).alias("v"))


QUERIES |= {f.__name__: f for f in (merged_lines, network_distance, street_samples, updated_geodata, contrastive_loss, joint_contrastive_loss, sampled_descriptors)}

_STREETS = "e AS (SELECT vec_id AS u, vec_id + 1 AS v FROM embeddings WHERE vec_id % 25 < 24 UNION ALL SELECT vec_id - 25, vec_id FROM embeddings WHERE vec_id >= 25 AND (vec_id % 25 = 0 OR vec_id % 25 = 24))"

ORACLES |= {
    "merged_lines": f"""WITH RECURSIVE {_STREETS}, n AS (SELECT *, row_number() OVER (ORDER BY least(u, v), greatest(u, v)) AS i FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e)),
t AS (SELECT i, u AS node FROM n UNION ALL SELECT i, v FROM n), two AS (SELECT node, min(i) AS a, max(i) AS b FROM t GROUP BY node HAVING count(*) = 2), l AS (SELECT a, b FROM two UNION SELECT b, a FROM two),
r AS (SELECT i, i AS j FROM n UNION SELECT r.i, l.b FROM r JOIN l ON l.a = r.j), c AS (SELECT i, min(j) AS line FROM r GROUP BY i)
SELECT min(u) AS low, max(v) AS high, count(*) + 1 AS n FROM c JOIN n USING (i) GROUP BY line""",
    "updated_geodata": f"""WITH {_vincenty().replace("o.lat AS lat0, o.lng AS lng0, o.alt AS alt0, o.azn AS azn0 FROM c0 c, c0 o WHERE o.entry_id = 0", "49.84e0 AS lat0, 24.03e0 AS lng0, 290e0 AS alt0, 0e0 AS azn0 FROM c0 c")},
ra AS (SELECT entry_id, radians(90 - azimuth) AS th, distance AS d, alt - alt0 AS up, radians(azn0 - azn) AS ya FROM geo), rb AS (SELECT entry_id, ya, cos(th) * d AS cx, -up AS cy, sin(th) * d AS cz FROM ra)
SELECT entry_id, 320e0 AS f, round(-(cos(ya) * cx + sin(ya) * cz), 4) + 0e0 AS t0, round(-cy, 4) + 0e0 AS t1, round(sin(ya) * cx - cos(ya) * cz, 4) + 0e0 AS t2, 49.84e0 AS baselat, 290e0 AS basealt FROM rb""",
    "joint_contrastive_loss": "SELECT p_partkey, round(ln(1 + exp(p_size / 10e0 - p_partkey % 17 / 5e0) + exp(p_size / 10e0 - p_partkey % 13 / 5e0) + exp(p_size / 10e0 - p_partkey % 11 / 5e0)), 6) AS loss FROM part",
    "network_distance": f"""WITH RECURSIVE {_STREETS}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS d UNION SELECT b.v, r.d + 1 FROM r JOIN b ON b.u = r.node WHERE r.d < 20) SELECT node, min(d)::DOUBLE AS dist FROM r GROUP BY node""",
    "contrastive_loss": "SELECT p_partkey, round(ln(1 + exp(p_size / 10e0 - p_partkey % 17 / 5e0)), 6) AS loss FROM part",
    "sampled_descriptors": f"""WITH {_FEATURES}, p AS (SELECT vec_id AS image, 4 + k * 2 AS y, 4 + k * 5 AS x, (4 + k * 2 - 4 + 0.5e0) / 8 AS fy, (4 + k * 5 - 4 + 0.5e0) / 8 AS fx FROM embeddings, range(0, 5) g(k)),
c AS (SELECT p.*, floor(fy) + a AS gy, floor(fx) + b AS gx, (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM p, (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b)),
s AS (SELECT c.image, c.y, c.x, f.channel, sum(w * value) AS v FROM c JOIN f ON f.image = c.image AND f.y = c.gy AND f.x = c.gx GROUP BY c.image, c.y, c.x, f.channel)
SELECT image, y, x, channel, round(v / sqrt(sum(v * v) OVER (PARTITION BY image, y, x)), 6) + 0e0 AS v FROM s""",
}
