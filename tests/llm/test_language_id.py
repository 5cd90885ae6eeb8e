"""Language identification: held-out accuracy and edge cases."""

from __future__ import annotations

import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from geolattice.llm.common import in_fold
from geolattice.llm.language_id import LanguageModel, fit_language_model, identify, keep_identified, share_out
from geolattice.llm.queries import q05_language_id

SYLLABLES = {"aa": ["ka", "mi", "to", "ru"], "bb": ["sch", "öl", "ung", "eit"], "cc": ["zio", "ne", "lla", "gli"]}


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(6, 80))]
        rows.append((i, " ".join(words), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = frame(spark, sample(400))
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit_language_model(docs.filter(~held_out), sample_rows=40, dictionary_bytes=4096)
    assert sorted(model.dictionaries) == ["aa", "bb", "cc"]
    assert all(len(d) <= 4096 for d in model.dictionaries.values())
    got = identify(docs.withColumn("lang_pred", F.lit("x")), model).join(docs, "doc_id").filter(held_out).collect()
    assert len(got) > 50
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def direct_sizes(text, dictionaries):
    """Bytes of each language by zstandard alone, block by block."""
    raw = bytes(c for c in text.lower().encode("utf-8", "replace") if c in b"\n " or 97 <= c <= 122 or c >= 128)
    parameters = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=3, search_log=4, window_log=18, hash_log=16, chain_log=16, write_content_size=False, write_checksum=False, write_dict_id=False)
    sizes = []
    for content in dictionaries.values():
        packer = zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        empty = len(packer.compress(bytes(64)))
        sizes.append(sum(len(packer.compress(raw[i : i + 4096] + bytes(64))) - empty for i in range(0, len(raw), 4096)))
    return sizes


def test_query_against_direct_encoding(spark, tmp_path):
    rng = random.Random(3)
    rows = [*sample(220, seed=4), (900, "zio", "cc"), (901, None, "aa"), (902, "!! 12", "bb"), (903, "kamito " * 3000 + "schöl ungeit " * 3000, "aa")]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(50)]
    rng.shuffle(rows)
    frame(spark, rows).selectExpr("*", "1 AS id", "2 AS score").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = fit_language_model(docs.filter(~in_fold(F.col("doc_id"), 5, 0)))
    got = {r.doc_id: r for r in q05_language_id.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sizes = direct_sizes(text, model.dictionaries)
        first, second = sorted(sizes)[:2]
        assert r.lang_pred == list(model.dictionaries)[sizes.index(first)]
        assert abs(r.margin - (second - first) / max(1, second)) < 1e-12 and r.rejected == (r.margin < 0.01)
        assert abs(r.score - 1 / sum(math.exp(-min(50.0, 8 * (x - first) / (8 + 0.05 * first))) for x in sizes)) < 1e-9


def test_long_and_repeated_texts_keep_their_language(spark):
    rng = random.Random(5)
    long = lambda: " ".join("".join(rng.choices(SYLLABLES["cc"], k=3)) for _ in range(6_000))
    rows = [(i, t, lang) for i, t, lang in sample(120) if lang != "cc"]
    rows += [(200 + i, " " * 40_000 + long(), "cc") for i in range(20)]
    once = [(400 + i, f"nuq {a} {b} Dah", "dd") for i, (a, b) in enumerate(zip("abcdefghijkl", "mnopqrstuvwx", strict=True))]
    model = fit_language_model(frame(spark, rows + once + [(1000 + i, "maj", "dd") for i in range(30_000)]), sample_rows=10)
    assert sorted(model.dictionaries) == ["aa", "bb", "cc", "dd"]
    assert len(model.dictionaries["cc"]) > 30_000 and model.dictionaries["dd"].count(b"\n") >= 8
    probe = frame(spark, [(1, long()[:300], None), (2, "nuq z y dah nuq", None)])
    assert {r.doc_id: r.lang_pred for r in identify(probe, model).collect()} == {1: "cc", 2: "dd"}


def test_dictionary_bytes_are_shared_out():
    assert share_out([b"a" * 10, b"b" * 2, b"c" * 10], 12) == b"aaaa\nbb\ncccc"
    assert share_out([b"ab", b"c"], 100) == b"ab\nc" and share_out([], 5) == b"" and len(share_out([b"abc"] * 50, 20)) == 20


def test_a_tie_goes_to_the_language_with_more_texts(spark):
    model = LanguageModel({"many": b"kamito rumika", "few": b"kamito rumika"})
    (r,) = identify(frame(spark, [(1, "kamito", None)]), model).collect()
    assert (r.lang_pred, r.margin, r.rejected) == ("many", 0.0, True)


def test_edge_cases(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "123 !?", None), (4, "kamito rumika " * 5000, "aa"), (4, "kamito rumika " * 5000, "aa"), (None, "schöl ungeit", None)]
    docs = frame(spark, rows)
    model = fit_language_model(frame(spark, [(i, t, lang) for i, t, lang in sample(100)] + [(900, "zz", None), (901, None, "dd")]))
    assert "dd" not in model.dictionaries
    got = sorted(((r.doc_id or 0), r.lang_pred, r.rejected) for r in identify(docs, model).collect())
    assert got == [(0, "bb", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False), (4, "aa", False)]
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4]
    assert identify(docs.limit(0), model).collect() == []
    assert fit_language_model(docs.limit(0)) == LanguageModel({})
    assert {r.lang_pred for r in identify(docs, LanguageModel({})).collect()} == {"und"}
