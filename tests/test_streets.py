"""Street graphs and geodata updates on small hand-made cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from geolattice.functions import geodesy
from geolattice.operators import geodata, streets


def test_lines_merge_through_plain_nodes_and_rings(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 3), (3, 9), (20, 21), (21, 22), (22, 20), (7, 7)]
    lines = {}
    for r in streets.merge_lines(spark.createDataFrame(edges, "u long, v long")).orderBy("line", "seq").collect():
        lines.setdefault(r.line, []).append(r.node)
    assert sorted(lines.values()) == [[1, 2, 3], [3, 4], [3, 9], [20, 21, 22, 20]]


def test_distances_and_boxes(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.5), (8, 9, 1.0)], "u long, v long, length double")
    assert {(r.node, r.dist) for r in streets.within_distance(edges, 0, 3.0).collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    nodes = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 0.5)], "id long, lat double, lng double")
    assert [r.id for r in streets.inside_box(nodes, 0, 0, 1, 1).collect()] == [1]


def test_samples_keep_their_spacing_and_jitter(spark):
    nodes = spark.createDataFrame([(1, 49.84, 24.03), (2, 49.85, 24.03)], "id long, lat double, lng double")
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    plain = streets.sample_streets(nodes, edges, 100.0)
    got = sorted(r.lat for r in plain.collect())
    gaps = [(b - a) * 111_200 for a, b in zip(got, got[1:], strict=False)]
    assert len(got) == 12 and all(95 < g < 110 for g in gaps)
    moved = streets.sample_streets(nodes, edges, 100.0, jitter=(1.0, 2.0), seed=4)
    assert sorted(moved.collect()) == sorted(streets.sample_streets(nodes, edges, 100.0, jitter=(1.0, 2.0), seed=4).collect())
    near = moved.crossJoin(plain.select(F.col("lat").alias("a"), F.col("lng").alias("b"))).select("lat", geodesy.inverse(F.col("a"), F.col("b"), F.col("lat"), F.col("lng"))["distance"].alias("d"))
    assert all(1.0 <= r.d <= 2.0 for r in near.groupBy("lat").agg(F.min("d").alias("d")).collect())


def test_updated_geodata_places_the_anchor_at_the_origin(spark):
    rows = spark.createDataFrame([(1, 640, 480, 49.84, 24.03, 300.0, 30.0, 90.0), (2, 640, 480, 49.841, 24.03, 310.0, 75.0, 60.0)], "entry_id long, w int, h int, lat double, lng double, alt double, azn double, fov double")
    out = {r.entry_id: r for r in geodata.update_geodata(rows, {"lat": 49.84, "lng": 24.03, "alt": 300.0, "azn": 30.0}).collect()}
    assert out[1].E == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], abs=1e-9)
    assert out[1].K[0] == pytest.approx(320) and out[2].K[0] == pytest.approx(320 / math.tan(math.radians(30)))
    assert out[2].E[7] == pytest.approx(10) and out[2].basealt == 300.0
