"""Street graphs: line merging, sub-graphs, sampling of coordinates along streets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.functions import geodesy
from geolattice.operators.spatial import components, resample_lines
from geolattice.scratch import staged


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): each street once, ends in order, loops dropped."""
    return edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a <> b").distinct()


def merge_lines(edges: DataFrame) -> DataFrame:
    """(line, seq, node): maximal lines through nodes of degree two.

    Edges that meet at such a node belong together; each line, bounded by one street, is then
    walked from its smaller end, a ring from its smallest node and back to it.
    """
    e = undirected(edges)
    e = staged(e.withColumn("i", F.xxhash64("a", "b")), "streets")
    ends = e.select("i", F.col("a").alias("node")).union(e.select("i", F.col("b").alias("node")))
    through = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("i").alias("x"), F.max("i").alias("y")).filter("n = 2")
    links = through.select(F.lit(0).alias("g"), F.col("x").alias("i"), F.col("y").alias("j")).filter("i <> j")
    lines = components(e.select(F.lit(0).alias("g"), "i"), links, "g")
    parts = lines.join(e, "i").select(F.col("comp").alias("line"), "a", "b")
    kind = e.schema["a"].dataType.simpleString()

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        around: dict = {}
        for a, b in sorted(zip(frame.a, frame.b, strict=True)):
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
        tips = sorted(n for n, other in around.items() if len(other) != 2) or sorted(around)
        path, before = [tips[0]], None
        while len(path) <= len(frame):
            onward = [n for n in around[path[-1]] if n != before] or around[path[-1]]
            before = path[-1]
            path.append(onward[0])
        return pd.DataFrame({"line": frame.line.iloc[0], "seq": range(len(path)), "node": path})

    return parts.groupBy("line").applyInPandas(walk, f"line long, seq int, node {kind}")


def inside_box(nodes: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return nodes.filter((F.col("lat") >= south) & (F.col("lat") <= north) & (F.col("lng") >= west) & (F.col("lng") <= east))


def nearest_node(nodes: DataFrame, lat: float, lng: float):
    """The id of the node (id, lat, lng) nearest to a point, of equally near ones the smallest; None without nodes."""
    d = geodesy.inverse(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))["distance"]
    best = nodes.select(F.struct(d.alias("d"), F.col("id").alias("id")).alias("n")).agg(F.min("n").alias("n")).first().n
    return best.id if best else None


def within_distance(edges: DataFrame, start: int, limit: float, max_rounds: int = 500) -> DataFrame:
    """(node, dist): nodes reached from ``start`` along edges (u, v, length) within ``limit``, by rounds of relaxation."""
    both = staged(edges.select("u", "v", "length").union(edges.select("v", "u", "length")), "arcs")
    spark = edges.sparkSession
    reached = spark.createDataFrame([(start, 0.0)], "node long, dist double")
    for _ in range(max_rounds):
        step = reached.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("dist")).filter(F.col("dist") <= limit)
        nxt = staged(reached.union(step).groupBy("node").agg(F.min("dist").alias("dist")), "reached")
        same = nxt.join(reached, ["node", "dist"], "left_anti").limit(1).count() == 0
        reached = nxt
        if same:
            return reached
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def sample_streets(nodes: DataFrame, edges: DataFrame, spacing: float, zone: int = 35, jitter: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """(lat, lng): distinct coordinates every ``spacing`` metres along merged streets.

    Nodes are (id, lat, lng), edges (u, v). With ``jitter`` each point moves by a distance
    between the two bounds and a direction, both drawn from its place and the seed.
    """
    lines = merge_lines(edges).join(nodes.select(F.col("id").alias("node"), "lat", "lng"), "node")
    flat = lines.withColumn("p", geodesy.utm_forward(F.col("lat"), F.col("lng"), zone)).select("line", "seq", F.col("p.east").alias("x"), F.col("p.north").alias("y"))
    points = resample_lines(flat, spacing).select(geodesy.utm_inverse(F.col("x"), F.col("y"), zone).alias("g"))
    points = points.select(F.round("g.lat", 7).alias("lat"), F.round("g.lng", 7).alias("lng")).distinct()
    if jitter is None:
        return points
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "lat", "lng"), F.lit(1_000_000)) / 1_000_000
    moved = geodesy.direct(F.col("lat"), F.col("lng"), draw(1) * 360, jitter[0] + draw(2) * (jitter[1] - jitter[0]))
    return points.select(moved.alias("g")).select("g.lat", "g.lng")
