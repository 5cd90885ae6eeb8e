"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the XXH64 values of word shingles. To find all
pairs at most ``radius`` bits apart, every bit position gets a non-zero label of radius + 1
bits; for each non-zero vector v a table keeps the bits whose label has an odd product with
v. The labels of ``radius`` differing bits span at most radius dimensions, so some v is
orthogonal to all of them and its table drops every differing bit: each such pair collides.

Inside the buckets no pairs are emitted. Two fingerprints within two bits meet at a value
that is one flip or none away from both, so each bucket member emits itself and its flips
over the bits that the table drops; at most 65 fingerprints can meet at one value, and
each is linked to the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import materialize, small_slices
from geolattice.llm.components import connected_components

BITS = 64
RADIUS = 2


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask of kept bits for each non-zero vector of radius + 1 bits."""
    span = (1 << (radius + 1)) - 1
    labels = [1 + i % span for i in range(bits)]
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2) for v in range(1, span + 1)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text, unsigned; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=">u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, "text"):
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(values)], names=[*names, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long): the fingerprint's bits as a signed integer."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp) that join exactly those within two bits."""
    masks = covering_masks(2)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    entries = distinct.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.key")
    shared = entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    members = entries.join(shared, ["t", "key"], "left_semi").select("t", "fp")
    dropped = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    flips = F.explode(F.transform(F.element_at(dropped, F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit)))
    meeting = members.select("fp", flips.alias("z")).groupBy("z").agg(F.collect_set("fp").alias("at")).filter("size(at) > 1")
    return meeting.select(F.explode(F.array_remove("at", F.array_min("at"))).alias("u"), F.array_min("at").alias("v")).distinct()


#: A fingerprint that more than one in so many rows have is looked up by broadcast; there are at most so many of them.
HOT_SHARE = 1024


def _owners(signed: DataFrame) -> DataFrame:
    """(fp, least, hot): each distinct fingerprint with its smallest id, and whether its rows are too many for one task."""
    distinct = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-owners")
    most = (distinct.agg(F.sum("n").alias("n")).first().n or 0) // HOT_SHARE
    return distinct.select("fp", "least", (F.col("n") > most).alias("hot") if most else F.lit(False).alias("hot"))


def _labelled(distinct: DataFrame) -> DataFrame:
    """(fp, least, hot, component): distinct fingerprints with the smallest fingerprint that they are linked to."""
    labels = connected_components(near_links(distinct.select("fp")))
    return distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", "hot", F.coalesce("component", "fp").alias("component"))


def _look_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (fp, ...) with what their fingerprint has in ``found`` (fp, hot, ...).

    Rows of hot fingerprints meet a broadcast table of at most ``HOT_SHARE`` rows where they
    are; the others, none of which has many rows, meet by shuffle.
    """
    found = materialize(found, "fingerprint-groups")
    hot = F.broadcast(found.filter("hot").drop("hot"))
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(found.filter("NOT hot").drop("hot"), "fp")
    return rows.join(hot, "fp").unionByName(cold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose fingerprints are linked by steps of at most two bits.

    Returns one row per input row: ``id_col``, fingerprint (16 hex digits), component_id (the
    smallest id reachable). NULL and empty texts have fingerprint zero and are linked like any
    other. Rows that repeat an id come back as often. A NULL id takes no part in the minimum;
    a group of NULL ids only has a NULL component. Texts of any length are read whole. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    signed = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    labelled = _labelled(_owners(signed))
    owners = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    found = _look_up(signed, labelled.join(owners, "component").select("fp", "hot", "component_id"))
    return found.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: one with the smallest id.

    Rows tie where they repeat that id, or where a group has NULL ids only; of those, the row
    with the smallest hash of all its columns stays, and of rows alike in every column one.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], order.alias("_order"))
    slim = rows.select(F.col(names[id_col]).cast("long").alias("doc_id"), "_order", F.col(names[text_col]).alias("text"))
    slim = materialize(slim.mapInArrow(_fingerprints, "doc_id long, _order long, fp long"), "fingerprints")
    component = _labelled(_owners(slim)).select("fp", "hot", "component")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_order").alias("o"))
    winners = _look_up(slim, component).groupBy("component").agg(F.min(rank).alias("w"))
    chosen = materialize(winners.select(F.col("w.i").alias("_id"), F.col("w.o").alias("_win")), "representatives")
    back = [F.col(n).alias(c) for c, n in names.items()]
    kept = rows.join(chosen, (F.col("_order") == F.col("_win")) & F.col(names[id_col]).cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["_order", names[id_col]]).select(*back)
