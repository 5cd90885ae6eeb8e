"""Exact deduplication by Patricia-trie owners.

1. Each task inserts the whole texts of a chunk of its rows into a trie, so that
   copies within a chunk become one *local class* before anything is shuffled.
   All rows, with the text of one row per class, go to a table in the shared folder.
2. The classes are dealt by text length and content hash. A group of copies, however
   large, sends at most one row per chunk there. Each partition inserts full byte
   strings into one trie; a terminal keeps the owner and the total count. The trie
   spills by subtree.
3. Rows look their class up. A class has no more rows than a chunk, so no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolattice.llm.common import CHUNK_BYTES, materialize, small_slices
from geolattice.llm.patricia import PatriciaTrie, flat_members

_LOCAL = [
    ("_class", T.LongType()),
    ("_rep", T.BooleanType()),
    ("_count", T.LongType()),
    ("_bytes", T.LongType()),
    ("_hash", T.LongType()),
    ("_sha", T.StringType()),
    ("_text", T.StringType()),
]


def _rank(doc_id, largest: bool) -> tuple:
    """Smaller ranks own a text; a NULL id owns it only if there is no other."""
    return (1, 0) if doc_id is None else (0, -doc_id if largest else doc_id)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _local_classes(largest: bool, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_class = (context.partitionId() if context else 0) << 40
        for batch in small_slices(batches, "_text", chunk_bytes):
            texts = batch.column("_text")
            keys = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.binary()).to_pylist()
            ids = batch.column("_id").to_pylist()
            trie = PatriciaTrie(max(4 * chunk_bytes, 2 * sum(map(len, keys))))
            for i, key in enumerate(keys):
                trie.insert(key, (*_rank(ids[i], largest), i), 1, i)
            n = len(keys)
            out = {"_class": [0] * n, "_rep": [False] * n, "_count": [0] * n, "_bytes": [0] * n, "_hash": [0] * n, "_sha": [""] * n}
            for t in trie.terminals():
                rep, members = t.best[-1], list(flat_members(t.members))
                key = keys[rep]
                size, digest, sha = len(key), _signed(xxhash.xxh64_intdigest(key)), hashlib.sha256(key).hexdigest()
                for i in members:
                    out["_class"][i], out["_bytes"][i], out["_hash"][i], out["_sha"][i] = next_class, size, digest, sha
                out["_rep"][rep], out["_count"][rep] = True, t.count
                next_class += 1
            arrays = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_text"]
            arrays += [pa.array(out[name]) for name, _ in _LOCAL[:-1]]
            arrays.append(pc.fill_null(texts, "").take(pa.array([i if rep else None for i, rep in enumerate(out["_rep"])], pa.int64())))
            names = [n for n in batch.schema.names if n != "_text"] + [name for name, _ in _LOCAL]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _owners(largest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in small_slices(batches, "_text"):
            keys = pc.ascii_lower(batch.column("_text")).cast(pa.binary())
            for key, doc_id, class_, count in zip(keys, batch.column("_id").to_pylist(), batch.column("_class").to_pylist(), batch.column("_count").to_pylist(), strict=True):
                trie.insert(key.as_py(), (*_rank(doc_id, largest), class_, doc_id), count, class_)
        rows: list[tuple] = []
        for t in trie.terminals():
            for class_ in flat_members(t.members):
                rows.append((class_, t.best[-1], t.best[-2], t.count))
                if len(rows) >= 20_000:
                    yield _owner_batch(rows)
                    rows = []
        if rows:
            yield _owner_batch(rows)

    return run


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["_class", "_keep_id", "_keep_class", "_size"])


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", carry: bool = False, chunk_bytes: int = CHUNK_BYTES, trie_budget: int = 96 << 20
) -> DataFrame:
    """Marks, of rows whose texts are equal up to the case of A-Z, the one that stays.

    Returns one row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.
    ``keep`` is "largest" or "smallest": which id owns a text. With ``carry`` only the
    rows that stay are returned, with all input columns (text as it was) instead.

    A NULL text counts as empty, and empty texts equal each other. Of rows that repeat
    both id and text one stays. A row with a NULL id stays only if all ids of its group
    are NULL; keep_id is then NULL. An empty table gives no rows. Other columns may have
    any names.
    """
    largest = {"largest": True, "smallest": False}[keep]
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    picked = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")]
    picked += [F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(extra)]
    nulls = F.col(f"`{text_col}`").isNull().alias("_null")
    rows = docs.select(*picked, nulls)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"] + [T.StructField(n, t) for n, t in _LOCAL])
    table = materialize(rows.mapInArrow(_local_classes(largest, chunk_bytes), schema), "dedup-rows")
    classes = table.filter("_rep").select("_id", "_class", "_count", "_bytes", "_hash", "_text")
    owners = classes.repartition("_bytes", "_hash").mapInArrow(_owners(largest, trie_budget), "_class long, _keep_id long, _keep_class long, _size long")
    if carry:
        kept = owners.filter("_class = _keep_class").select("_class")
        back = {id_col: F.col("_id"), text_col: F.when(~F.col("_null"), F.col("_text"))} | {c: F.col(f"_x{i}") for i, c in enumerate(extra)}
        found = table.filter("_rep").join(kept, "_class", "left_semi")
        return found.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    found = table.select("_id", "_class", "_rep", "_sha").join(owners, "_class")
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_rep") & (F.col("_class") == F.col("_keep_class"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
