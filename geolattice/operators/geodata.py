"""Metadata updates relative to an anchor, and a loss over descriptor distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.functions import camera, geodesy


def update_geodata(entries: DataFrame, anchor: dict[str, float]) -> DataFrame:
    """Adds K, E (relative to the anchor's lat, lng, alt, azn) and base* to every entry; a new K or E wins over an old one."""
    lat, lng, alt, azn = (F.lit(float(anchor[k])) for k in ("lat", "lng", "alt", "azn"))
    k = camera.intrinsics(F.col("w"), F.col("h"), F.col("fov"), F.col("K") if "K" in entries.columns else None)
    c = geodesy.relative_position(lat, lng, alt, azn, F.col("lat"), F.col("lng"), F.col("alt"))
    r = camera.rotation_y(azn - F.col("azn"))
    placed = entries.withColumns({"K": k, "_c": c, "_r": camera.column(r)})
    e = camera.pose_matrix(F.col("_r"), camera.translation_from_center(F.col("_r"), F.col("_c")))
    return placed.withColumns({"E": camera.column(e), "baselat": lat, "baselng": lng, "basealt": alt, "baseazn": azn}).drop("_c", "_r")


def contrastive_loss(positive: Column, negative: Column) -> Column:
    """-log softmax of negated squared distances of a positive against one negative."""
    return F.log1p(F.exp(positive - negative))


def joint_contrastive_loss(positive: Column, negatives: Column) -> Column:
    """-log softmax of negated squared distances of a positive against an array of negatives."""
    return F.log1p(F.aggregate(negatives, F.lit(0.0), lambda acc, n: acc + F.exp(positive - n)))
