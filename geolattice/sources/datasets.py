"""Readers for directory datasets, pose files and arrays, all as DataFrames.

Files are read through Spark's binaryFile and text sources, so any store that Spark can reach
works; arrays are decoded from their bytes in Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import camera
from geolattice.functions.text import starts_with_pattern

METADATA = "w int, h int, lat double, lng double, alt double, azn double, fov double, K array<array<double>>, E array<array<double>>, distortion_coefficients array<double>"


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def _entry() -> Column:
    """Name of a file's directory."""
    return F.element_at(F.split("path", "/"), -2)


def list_entries(spark: SparkSession, root: str) -> DataFrame:
    """(entry_id): every sub-directory of a dataset, empty ones too; files beside them are none.

    Like any file listing of Spark's it runs on the driver and reads no content.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(top)
    names = []
    while listing.hasNext():
        status = listing.next()
        if status.isDirectory():
            names.append((status.getPath().getName(),))
    return spark.createDataFrame(names, "entry_id string")


def _decode_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, content in zip(batch.column("kind").to_pylist(), batch.column("content"), strict=True):
            array = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
            n = len(array)
            names = array.astype(str).tolist() if kind == "entries" else [None] * n
            poses = [None] * n if kind == "entries" else array.astype(float).reshape(n, 16).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(range(n), pa.int64()), pa.array(names, pa.string()), pa.array(poses, pa.list_(pa.float64()))], names=["kind", "n", "entry_id", "e"])


def read_experiment_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(entry_id, gt, est): rows of entries.npy with the poses, 16 numbers each, of gt.npy and estm.npy at the same place."""
    kind = F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("kind")
    rows = _files(spark, folder, "{entries,gt,estm}.npy").select(kind, "content").mapInArrow(_decode_arrays, "kind string, n long, entry_id string, e array<double>")
    part = lambda name, column, alias: rows.filter(F.col("kind") == name).select("n", F.col(column).alias(alias))
    return part("entries", "entry_id", "entry_id").join(part("gt", "e", "gt"), "n").join(part("estm", "e", "est"), "n").drop("n")


def read_experiment(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Results written by ``sinks.write_experiment``; all experiments, or the one of that name."""
    found = spark.read.parquet(root)
    return found if name is None else found.filter(F.col("exp_name") == name)


def reference_entries(entries: DataFrame, queries: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(entry_id): the references given, or all entries that are no query."""
    if references is not None:
        return references.select("entry_id")
    return entries.select("entry_id").join(queries, "entry_id", "left_anti")


def read_street_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(id, lat, lng) and (u, v) tables of a street graph in Parquet."""
    return spark.read.parquet(nodes).select("id", "lat", "lng"), spark.read.parquet(edges).select("u", "v")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(entry_id, known fields, extras): one JSON object per metadata.json.

    K and E become row-major arrays; fields beyond the known ones stay in ``extras``, a VARIANT.
    """
    raw = _files(spark, root, "metadata.json").select(_entry().alias("entry_id"), F.decode("content", "UTF-8").alias("json"))
    parsed = raw.withColumn("m", F.from_json("json", METADATA))
    plain = ["w", "h", "lat", "lng", "alt", "azn", "fov"]
    return parsed.select("entry_id", *[F.col(f"m.{c}") for c in plain], F.flatten("m.K").alias("K"), F.flatten("m.E").alias("E"), "m.distortion_coefficients", F.parse_json("json").alias("extras"))


def _decode_npy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays = [np.load(io.BytesIO(b.as_py()), allow_pickle=False).astype(np.float32).reshape(-1).tolist() for b in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("entry_id"), pa.array(arrays, pa.list_(pa.float32()))], names=["entry_id", "v"])


def read_descriptors(spark: SparkSession, root: str, descriptor_type: str) -> DataFrame:
    """(entry_id, descriptor_type, v) from <descriptor_type>_descriptor.npy files of shape D or 1 by D."""
    if not descriptor_type:
        raise ValueError("a descriptor type is needed")
    raw = _files(spark, root, f"{descriptor_type}_descriptor.npy").select(_entry().alias("entry_id"), "content")
    return raw.mapInArrow(_decode_npy, "entry_id string, v array<float>").select("entry_id", F.lit(descriptor_type).alias("descriptor_type"), "v")


def _decode_npz(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entry, content in zip(batch.column("entry_id").to_pylist(), batch.column("content"), strict=True):
            with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                points, scores = z["keypoints"].astype(np.float32).reshape(-1, 2), z["scores"].astype(np.float32).reshape(-1)
                desc = z["descriptors"].astype(np.float32).T if "descriptors" in z.files else np.zeros((len(points), 0), np.float32)
            n = len(points)
            yield pa.RecordBatch.from_arrays(
                [pa.array([entry] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(points[:, 0]), pa.array(points[:, 1]), pa.array(scores), pa.array(desc.tolist(), pa.list_(pa.float32()))],
                names=["entry_id", "kp_idx", "x", "y", "score", "desc"],
            )


def read_keypoints(spark: SparkSession, root: str) -> DataFrame:
    """(entry_id, kp_idx, x, y, score, desc): one row per keypoint of every keypoints.npz."""
    raw = _files(spark, root, "keypoints.npz").select(_entry().alias("entry_id"), "content")
    return raw.mapInArrow(_decode_npz, "entry_id string, kp_idx int, x float, y float, score float, desc array<float>")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(entry_id, image): encoded bytes; decoding is left to the model hook."""
    return _files(spark, root, "image.jpg").select(_entry().alias("entry_id"), F.col("content").alias("image"))


def match_paths(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path): files under ``root`` whose path below it matches a pattern from its start."""
    base = root.rstrip("/")
    below = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", r"\.").removeprefix("file://") + "/", "")
    return _files(spark, root, "*").select(below.alias("path")).filter(starts_with_pattern(F.col("path"), pattern))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file in order, from 0. Files of poses are small."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).filter(F.trim("value") != "")


def read_aachen_intrinsics(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """(name, w, h, K, distortion): space-separated name, model, w, h, focal, cx, cy, r; shrunk to ``target`` if that is smaller."""
    p = F.split(F.trim("value"), " +")
    num = lambda i: F.get(p, i).cast("double")
    rows = _lines(spark, path).select(F.get(p, 0).alias("name"), num(2).alias("w"), num(3).alias("h"), num(4).alias("f"), num(5).alias("cx"), num(6).alias("cy"), num(7).alias("r"))
    scale = F.lit(1.0) if target is None else F.least(F.lit(1.0), F.lit(float(target)) / F.greatest("w", "h"))
    z, one = F.lit(0.0), F.lit(1.0)
    rows = rows.withColumn("s", scale)
    f, cx, cy = (F.col(c) * F.col("s") for c in ("f", "cx", "cy"))
    return rows.select("name", F.bround(F.col("w") * F.col("s"), 0).cast("int").alias("w"), F.bround(F.col("h") * F.col("s"), 0).cast("int").alias("h"), F.array(f, z, cx, z, f, cy, z, z, one).alias("K"), F.array(F.col("r"), z, z, z, z).alias("distortion"))


def _posed(rows: DataFrame) -> DataFrame:
    """(name, R, T) from name, qw..qz and centre cx..cz."""
    r = camera.quaternion_to_matrix(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    with_r = rows.select("name", r.alias("R"), F.array("cx", "cy", "cz").alias("c"))
    return with_r.select("name", "R", camera.translation_from_center(F.col("R"), F.col("c")).alias("T"))


def read_aachen_extrinsics(spark: SparkSession, path: str) -> DataFrame:
    """(name, R, T): two lines are skipped, the third gives the number of lines that follow."""
    lines = _lines(spark, path)
    count = lines.filter("n = 2").select(F.trim("value").cast("int").alias("count"))
    p = F.split(F.trim("value"), "[ \t]+")
    names = ("focal", "qw", "qx", "qy", "qz", "cx", "cy", "cz")
    body = lines.join(F.broadcast(count)).filter("n > 2 AND n <= 2 + count")
    return _posed(body.select(F.get(p, 0).alias("name"), *[F.get(p, i).cast("double").alias(c) for i, c in enumerate(names, 1)]))


def merge_poses(intrinsics: DataFrame, poses: DataFrame) -> DataFrame:
    """Intrinsics with the pose of the same name; raises if a pose names no camera."""
    lost = poses.join(intrinsics, "name", "left_anti").limit(1).collect()
    if lost:
        raise KeyError(lost[0]["name"])
    return intrinsics.join(poses, "name", "left")


def read_cambridge_poses(spark: SparkSession, path: str) -> DataFrame:
    """(name, R, T): three header lines, then path, centre and quaternion (w first)."""
    p = F.split(F.trim("value"), r"\s+")
    names = ("cx", "cy", "cz", "qw", "qx", "qy", "qz")
    return _posed(_lines(spark, path).filter("n > 2").select(F.get(p, 0).alias("name"), *[F.get(p, i).cast("double").alias(c) for i, c in enumerate(names, 1)]))
