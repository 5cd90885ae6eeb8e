"""Spatial validation: proximity links, connected components, largest cluster; line resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.scratch import staged


def proximity_links(points: DataFrame, group_col: str, threshold: float) -> DataFrame:
    """(group, i, j): pairs of points of one group strictly closer than ``threshold``, i < j.

    Points are (group, i, x, y, z). They are cut into cells of the threshold's size; a point
    meets the 27 cells around its own by equality, so only neighbours are compared.
    """
    cell = lambda c: F.floor(F.col(c) / threshold)
    placed = points.withColumns({"cx": cell("x"), "cy": cell("y"), "cz": cell("z")})
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    left = placed.withColumn("d", F.explode(around)).select(F.col(group_col), F.col("i"), "x", "y", "z", (F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy"), (F.col("cz") + F.col("d.c")).alias("cz"))
    right = placed.select(group_col, F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), "cx", "cy", "cz")
    d2 = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("z") - F.col("z2"), 2)
    return left.join(right, [group_col, "cx", "cy", "cz"]).filter((F.col("i") < F.col("j")) & (F.sqrt(d2) < threshold)).select(group_col, "i", "j")


def components(nodes: DataFrame, links: DataFrame, group_col: str, max_rounds: int = 200) -> DataFrame:
    """(group, i, comp): every node with the smallest node that it is linked to, directly or not.

    Each round takes the least label around and then the label's own label, written out
    before the next; the rounds end when no label changes.
    """
    both = staged(links.select(group_col, "i", "j").union(links.select(group_col, F.col("j").alias("i"), F.col("i").alias("j"))), "links")
    state = staged(nodes.select(group_col, "i", F.col("i").alias("comp")), "labels")
    for _ in range(max_rounds):
        near = both.join(state.select(group_col, F.col("i").alias("j"), F.col("comp").alias("other")), [group_col, "j"]).groupBy(group_col, "i").agg(F.min("other").alias("least"))
        moved = state.join(near, [group_col, "i"], "left").select(group_col, "i", F.least("comp", F.coalesce("least", "comp")).alias("comp"), F.col("comp").alias("was"))
        jump = moved.select(group_col, F.col("i").alias("comp"), F.col("comp").alias("top"))
        nxt = staged(moved.join(jump, [group_col, "comp"]).select(group_col, "i", F.col("top").alias("comp"), "was"), "labels")
        changed = nxt.filter("comp <> was").limit(1).count()
        state = nxt.drop("was")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def largest_cluster(points: DataFrame, group_col: str, threshold: float, least: int = 2) -> DataFrame:
    """(group, i): members of each group's largest proximity cluster, of equal ones that with the smallest i; groups with fewer than ``least`` members give no row."""
    comp = components(points, proximity_links(points, group_col, threshold), group_col)
    sizes = comp.groupBy(group_col, "comp").agg(F.count("*").alias("n"))
    best = sizes.groupBy(group_col).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("comp").alias("comp"))).alias("b")).filter(-F.col("b.n") >= least)
    return comp.join(best.select(group_col, F.col("b.comp").alias("comp")), [group_col, "comp"]).select(group_col, "i")


def resample_lines(vertices: DataFrame, spacing: float, tolerance: float = 1.5) -> DataFrame:
    """(line, n, x, y): both ends of each line and the points that cut it into int(length / spacing) even parts.

    Vertices are (line, seq, x, y). Lines shorter than spacing / tolerance are skipped.
    """
    order = Window.partitionBy("line").orderBy("seq")
    step = vertices.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    leg = step.withColumn("leg", F.coalesce(F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)), F.lit(0.0)))
    along = leg.withColumn("end", F.sum("leg").over(order)).withColumn("start", F.col("end") - F.col("leg"))
    total = along.groupBy("line").agg(F.max("end").alias("length")).filter(F.col("length") >= spacing / tolerance)
    parts = F.greatest(F.floor(F.col("length") / spacing), F.lit(1))
    stops = total.select("line", "length", parts.alias("parts")).select("line", "length", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))).alias("n"))
    stops = stops.withColumn("at", F.col("n") * F.col("length") / F.col("parts"))
    first = (F.col("n") == 0) & (F.col("start") == 0)
    last = (F.col("n") == F.col("parts")) & (F.col("end") == F.col("length"))
    inside = (F.col("n") > 0) & (F.col("n") < F.col("parts")) & (F.col("at") > F.col("start")) & (F.col("at") <= F.col("end"))
    hit = along.filter("leg > 0").join(stops, "line").filter(first | last | inside)
    share = (F.col("at") - F.col("start")) / F.col("leg")
    return hit.select("line", "n", (F.col("px") + share * (F.col("x") - F.col("px"))).alias("x"), (F.col("py") + share * (F.col("y") - F.col("py"))).alias("y")).dropDuplicates(["line", "n"])


def same_position(a: list[Column], b: list[Column]) -> Column:
    """Whether each |a - b| is at most 1e-8 + 1e-5 |b|; not symmetric."""
    near = F.lit(True)
    for x, y in zip(a, b, strict=True):
        near = near & (F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y))
    return near
