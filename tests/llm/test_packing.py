"""Packing: every id in exactly one piece, sequences gapless and full, checksums right."""

from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pytest

from geolattice.llm import packing
from geolattice.llm.packing import pack, padded, plan_slots, token_ids

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def slow_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_encode_like_whole_texts():
    rng = random.Random(1)
    alphabet = " \t\n\r\x0b\x00\x1c\x85\xa0\xad abcXYZ'sll019_.,!äßñ´€Жλ中​\U0001f600　"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["<|endoftext|>", "a <|endoftext|>b", "it's we'll I'D", "   x", "x   ", "\n\n\n a"]
    for t in texts:
        assert token_ids(t, VOCABULARY).tolist() == slow_ids(t)[:-1], repr(t)


LONG = {"spaces": " " * 2_000_000 + "x", "feeds": "\n" * 2_000_000, "letters": "a" * 2_000_000, "word": "abcdefghijk" * 450_000, "words": "it's 12 of\tä  " * 200_000, "others": "中文\x85 " * 100_000}


@pytest.mark.parametrize("name", list(LONG))
def test_long_texts_and_runs_encode_alike(name):
    assert token_ids(LONG[name], VOCABULARY).tolist() == slow_ids(LONG[name])[:-1]


def test_remembered_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_SEGMENT", 9)
    known = packing.PieceIds(VOCABULARY, most=20, longest=6)
    monkeypatch.setattr(packing, "_piece_ids", lambda _: known)
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choices("  \n\tab'slre12.,éЖ", k=rng.randint(0, 60)))
        assert token_ids(t, VOCABULARY).tolist() == slow_ids(t)[:-1], repr(t)
        assert len(known) <= 20 and all(len(p) <= 6 for p in known)


def test_long_text_packs_beside_clashing_columns(spark):
    texts = {1: " " * 1_000_000, 2: "a b", 3: "\n" * 1_000_000 + "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS task", "2 AS local", "'n' AS n", "3 AS low", "4 AS start")
    check(pack(docs, VOCABULARY).collect(), texts, 1024)


def check(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = slow_ids(texts[doc_id]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += padded(at, capacity)
    return total


@pytest.mark.parametrize("capacity", [16, 1024])
def test_round_trip(spark, capacity):
    rng = random.Random(4)
    words = ["alpha", "the", "Übung", "x1", "\n", "señor,"]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300, 3000]))) for i in range(150)}
    texts |= {900: None, 901: "", 902: "hot " * 40}
    texts |= {i: texts[902] for i in range(1000, 1080)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6).selectExpr("*", "'z' AS length", "0 AS rank")
    rows = pack(docs, VOCABULARY, capacity=capacity).collect()
    used = check(rows, texts, capacity)
    tokens = sum(r.length for r in rows)
    assert used <= tokens * 1.03 + capacity


def test_slots_cover_all_ranks_with_little_padding():
    rng = np.random.default_rng(2)
    for n in (1, 7, 500, 20_000):
        lengths = 1 + (rng.lognormal(6, 1, n).astype(int) % 1024)
        histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
        slots = plan_slots(histogram, 1024)
        for length, count in histogram.items():
            spans = sorted((low, high) for l, low, high, *_ in slots if l == length)
            assert spans[0][0] == 0 and spans[-1][1] == count
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        fill = {}
        for length, low, high, per, sequence, _ in slots:
            for s in range(sequence, sequence + (high - low) // per):
                fill[s] = fill.get(s, 0) + length * per
        tokens = sum(a * b for a, b in histogram.items())
        assert sum(fill.values()) == tokens and max(fill.values()) <= 1024
        if n >= 500:
            assert sum(padded(v, 1024) for v in fill.values()) <= 1.02 * tokens


def test_empty_table_null_and_repeated_ids(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (3, "other words here")], "doc_id long, text string")
    rows = pack(docs, VOCABULARY, capacity=16).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == sorted([(-1, 3), (3, 3), (3, 3), (3, len(slow_ids("other words here")))])
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == len(rows)
