"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with known text. A text is
encoded block by block with every language's dictionary; the language whose dictionary
gives the smallest total wins, and a narrow margin over the runner-up rejects the text.
Each row is scored by itself: nothing shuffles but the bounded training sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolattice.llm.common import small_slices

UNDETERMINED = "und"
BLOCK = 4096
#: Zero bytes after each block: their saving keeps zstandard from storing short blocks as they are.
PAD = bytes(64)
_DROPPED = bytes(c for c in range(128) if not (97 <= c <= 122 or c in (10, 32)))
_LETTER = re.compile("[A-Za-z]")


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language; the first of two languages wins a tie."""

    dictionaries: dict[str, bytes]


def normal_form(text: str) -> bytes:
    """Lower-case UTF-8 without ASCII digits, punctuation and control characters but line feed."""
    return text.lower().encode("utf-8", "replace").translate(None, _DROPPED)


def fit_language_model(
    train: DataFrame, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = 1 << 16, sample_rows: int = 400, slice_chars: int = 16_000, max_languages: int = 1000
) -> LanguageModel:
    """Fills one dictionary per language from a bounded sample of the labelled rows.

    For each non-null language at most ``sample_rows`` distinct texts with a letter are drawn by
    hash, whatever their lengths and however often they repeat. Of each drawn text one slice of
    at most ``slice_chars`` characters, at a place told by its hash, comes to the driver, once
    marks other than letters are taken out and long blanks shortened. The texts share
    ``dictionary_bytes`` evenly; what short ones leave goes to longer ones. A language with any
    labelled letter has a dictionary. Raises if there are more than ``max_languages``.
    """
    rows = train.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return LanguageModel({})
    spread = 1 << 30
    cuts = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(spread, 3 * sample_rows * spread // max(1, n)))])
    draw = rows.filter(F.pmod("h", F.lit(spread)) < F.element_at(cuts, F.col("lang")))
    plain = F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\s]+", ""), r"\s{9,}", " ")
    size = F.char_length("plain")
    place = F.pmod(F.xxhash64("h"), F.greatest(size - slice_chars, F.lit(0)) + 1).cast("int")
    sliced = draw.select("lang", "h", plain.alias("plain")).select("lang", "h", F.substring("plain", place + 1, F.lit(slice_chars)).alias("part"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(spread)), "h"))
    drawn = sliced.groupBy("lang", "h").agg(F.min("part").alias("part")).withColumn("n", order).filter(F.col("n") <= sample_rows)
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in drawn.select("lang", "part", "n").collect():  # at most sample_rows slices a language
        parts.setdefault(r.lang, []).append((r.n, normal_form(r.part)))
    return LanguageModel({lang: share_out([t for _, t in sorted(found)], dictionary_bytes) for lang, found in sorted(parts.items(), key=lambda kv: (-counts[kv[0]], kv[0]))})


def share_out(texts: list[bytes], size: int) -> bytes:
    """The texts on lines of their own, in at most ``size`` bytes: each is cut to the largest length at which all fit."""
    low, high = 0, size
    while low < high:
        mid = (low + high + 1) // 2
        if sum(min(len(t), mid) + 1 for t in texts) <= size + 1:
            low = mid
        else:
            high = mid - 1
    return b"\n".join(t[: max(1, low)] for t in texts)[:size]


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def _compressors(dictionaries: dict[str, bytes]) -> list:
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=3, search_log=4, window_log=18, hash_log=16, chain_log=16, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    made = []
    for content in dictionaries.values():
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=parameters)
        made.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=data))
    return made


def code_lengths(text: bytes, compressors: list) -> np.ndarray:
    """Bytes that the whole text takes with each dictionary, without what an empty block takes."""
    blocks = [text[i : i + BLOCK] + PAD for i in range(0, len(text), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) - len(blocks) * len(c.compress(PAD)) for c in compressors], dtype=float)


class Judge:
    """Tells the languages of texts; its compressors are made once."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float) -> None:
        self.languages, self.min_margin = list(dictionaries), min_margin
        self.compressors = _compressors(dictionaries)

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected) of a whole text."""
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = code_lengths(normal_form(text), self.compressors)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = float((sizes[order[1]] - best) / max(1.0, sizes[order[1]])) if len(order) > 1 else 1.0
        weights = np.exp(-np.minimum(50.0, 8 * (sizes - best) / (8 + 0.05 * best)))
        return self.languages[order[0]], float(1 / weights.sum()), margin, margin < self.min_margin


def _identify(dictionaries: dict[str, bytes], min_margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, min_margin)
        for batch in small_slices(batches, "text"):
            columns = list(zip(*(judge(t.as_py()) for t in batch.column("text")), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], names=["id", "lang_pred", "score", "margin", "rejected"])

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """Predicts the language of every whole text.

    Returns one row per input row: ``id_col``, lang_pred, score (0 to 1, the winner's share of
    softened code lengths), margin (saving over the runner-up) and rejected (margin under
    ``min_margin``, or no prediction). NULL texts, texts without a letter and models without
    a language give ``und``, score 0, rejected. Where two languages take as many bytes, the one
    with more labelled texts wins and the margin is zero. Texts of any length are encoded whole,
    block by block. NULL and repeated ids come back as they are; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_identify(model.dictionaries, min_margin), f"id {id_type}, lang_pred string, score double, margin double, rejected boolean")
    return found.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not rejected.

    NULL texts and texts without a letter go; repeated rows stay or go together, an empty table
    gives no rows, and columns may have any names.
    """
    dictionaries, at = model.dictionaries, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, min_margin)
        for batch in batches:
            yield batch.filter(pa.array([not judge(t.as_py())[-1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
