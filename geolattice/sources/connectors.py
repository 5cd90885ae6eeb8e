"""Connectors to map services with an injected client; nothing here opens a connection itself.

A client is a picklable function. It runs in the tasks, one call per row or chunk; a failed
call gives a row with its error, so that one failure never loses or shifts others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators import datasets


def fetch_metadata(coords: DataFrame, client: Callable[[float, float], dict]) -> DataFrame:
    """(ord, lat, lng, pano_id, status, error) for coordinates (ord, lat, lng)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                try:
                    m = client(r.lat, r.lng)
                    at = m.get("location", {})
                    rows.append((r.ord, at.get("lat"), at.get("lng"), m.get("pano_id"), m.get("status"), None))
                except Exception as e:
                    rows.append((r.ord, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["ord", "lat", "lng", "pano_id", "status", "error"])

    return coords.select("ord", "lat", "lng").mapInPandas(run, "ord long, lat double, lng double, pano_id string, status string, error string")


def keep_panoramas(fetched: DataFrame) -> DataFrame:
    """Of rows with status ok, in any case, the first of each panorama."""
    return datasets.keep_first(fetched.filter(F.lower("status") == "ok"), "pano_id", "ord")


def fetch_elevations(entries: DataFrame, client: Callable[[list[tuple[float, float]]], list[float]], chunk: int = 300) -> DataFrame:
    """(entry_id, alt, error): one call per chunk of entries (entry_id, lat, lng); results go back by key."""
    parts = datasets.chunks(entries.select("entry_id", "lat", "lng"), "entry_id", chunk)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        try:
            found = client(list(zip(frame.lat, frame.lng, strict=True)))
            if len(found) != len(frame):
                raise ValueError(f"{len(found)} elevations for {len(frame)} entries")
            return pd.DataFrame({"entry_id": frame.entry_id, "alt": found, "error": None})
        except Exception as e:
            return pd.DataFrame({"entry_id": frame.entry_id, "alt": float("nan"), "error": str(e)})

    kind = entries.schema["entry_id"].dataType.simpleString()
    out = parts.groupBy("chunk").applyInPandas(run, f"entry_id {kind}, alt double, error string")
    return out.withColumn("alt", F.when(F.isnan("alt"), None).otherwise(F.col("alt")))


def panorama_requests(entries: DataFrame, fov: float, n: int, size: int = 640) -> DataFrame:
    """(target_id, entry_id, heading, fov, size): one image per heading; the first keeps the entry's id."""
    rows = datasets.headings(entries.select("entry_id"), n)
    target = F.when(F.col("heading") == 0, F.col("entry_id").cast("string")).otherwise(F.concat_ws("_", F.col("entry_id").cast("string"), F.col("heading").cast("string")))
    return rows.select(target.alias("target_id"), "entry_id", "heading", F.lit(float(fov)).alias("fov"), F.lit(size).alias("size"))


def fetch_panoramas(requests: DataFrame, client: Callable[[str, int, float, int], bytes], present: DataFrame | None = None) -> DataFrame:
    """(target_id, entry_id, image, w, h, azn, fov, error) for the rows of ``panorama_requests``, one call each.

    The client takes entry, heading, field of view and size. Entries in ``present`` (entry_id,
    azn) have an image already: their own heading is not asked for again, and others go to an
    id of their own.
    """
    rows = requests
    if present is not None:
        held = present.select("entry_id", F.col("azn").alias("_azn"), F.lit(True).alias("_held"))
        rows = rows.join(held, "entry_id", "left").filter(F.col("_held").isNull() | ~F.col("_azn").eqNullSafe(F.col("heading")))
        own = F.when(F.col("_held"), F.concat_ws("_", F.col("entry_id").cast("string"), F.col("heading").cast("string"))).otherwise(F.col("target_id"))
        rows = rows.withColumn("target_id", own)
    kind = requests.schema["entry_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                image, error = None, None
                try:
                    image = client(r.entry_id, r.heading, r.fov, r.size)
                except Exception as e:
                    error = str(e)
                yield pd.DataFrame({"target_id": [r.target_id], "entry_id": [r.entry_id], "image": [image], "w": [r.size], "h": [r.size], "azn": [float(r.heading)], "fov": [r.fov], "error": [error]})

    schema = f"target_id string, entry_id {kind}, image binary, w int, h int, azn double, fov double, error string"
    return rows.select("target_id", "entry_id", "heading", "fov", "size").mapInPandas(run, schema)


def fetch_street_graph(spark: SparkSession, query: str | tuple[float, float], client: Callable[..., tuple[list, list]], radius: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, lat, lng) and (u, v) tables of the streets of a place, or of a disc around (lat, lng); other queries raise ValueError."""
    if isinstance(query, str):
        nodes, edges = client(place=query)
    elif isinstance(query, (list, tuple)) and radius is not None:
        nodes, edges = client(point=tuple(query), radius=radius)
    else:
        raise ValueError("a place, or a point and a radius, is needed")
    return spark.createDataFrame(nodes, "id long, lat double, lng double"), spark.createDataFrame(edges, "u long, v long")
