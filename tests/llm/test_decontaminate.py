"""Benchmark decontamination against brute force."""

from __future__ import annotations

import random
import re

import pytest

from geolattice.llm.decontaminate import find_contamination, proximity_matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow(docs, items, length):
    windows = []
    for item_id, text in items:
        w = words(text)
        n = min(length, len(w))
        windows += [(item_id, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, k in windows:
            for i in range(len(w) - len(k) + 1):
                if w[i : i + len(k)] == k:
                    hit |= set(range(i, i + len(k)))
                    found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def data():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(25)] + ["Éa", "éa", "the", "THE", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(14)]
    items += [(50, None), (51, "!!"), (52, items[3][1]), (53, "absent words only here"), (None, items[5][1])]
    docs = []
    for i in range(120):
        parts = rng.choices(vocabulary, k=rng.randint(0, 40))
        if rng.random() < 0.5:
            at = rng.randint(0, len(parts))
            parts[at:at] = (rng.choice(items[:14])[1] + " ").upper().split()
        docs.append((i, ", ".join(parts)))
    hot = items[5][1] + " . " + items[4][1]
    docs += [(200 + i, "w1 " + hot) for i in range(40)]
    docs += [(300, None), (301, ""), (302, (hot + " ") * 400), (7, "another text w1 w2"), (7, "another text w1 w2")]
    return docs, items


@pytest.mark.parametrize(("length", "limit"), [(10, 400_000), (10, 0), (4, 400_000)])
def test_phrases_against_brute_force(spark, length, limit):
    docs, items = data()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "'q' AS words", "1 AS row", "2 AS _row")
    found = find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), length=length, broadcast_rows=limit)
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect())
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in found.collect())
    assert got == sorted(slow(docs, items, length))


def test_carry_keeps_clean_rows_whole(spark):
    docs, items = data()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' AS _c0")
    kept = find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), carry=True)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text or "~") for r in kept.collect()) == sorted((d, t or "~") for (d, t), s in zip(docs, slow(docs, items, 10), strict=True) if not s[2])


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_contamination(none, items).collect() == []
    docs = spark.createDataFrame([(None, "x a B c")], "doc_id long, text string")
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in find_contamination(docs, items).collect()] == [(None, 4, 3, 1)]
    assert [r.n_hit for r in find_contamination(docs, items.limit(0)).collect()] == [0]


def test_proximity_allows_gaps(spark):
    items = spark.createDataFrame([(1, "red fox jumps over hedge")], "item_id long, text string")
    docs = [(1, "red fox jumps over hedge"), (2, "red old fox jumps high over a hedge"), (3, "hedge over fox red"), (4, "red " + "z " * 30 + "fox jumps " + "z " * 30 + "over hedge"), (5, "none")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    near = lambda slop: sorted({r.doc_id for r in proximity_matches(frame, items, slop).collect()})
    assert near(0) == [1]
    assert set(near(3)) == {1, 2}
    assert near(200) == [1, 2, 4]  # the third lacks a word


def test_edited_windows_match_nearly_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 16])))) for i in range(6)] + [(90, None), (91, "!!")]
    docs = []
    for i in range(60):
        w = words(rng.choice(items[:6])[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + ["absent" + str(i)] + w[at + 1 :], w[:at] + [rng.choice(vocabulary)] + w[at:]])
            w = w or ["x"]
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 8)) + w + rng.choices(vocabulary, k=5))))
    docs += [(100, None), (101, ""), (101, "w1 w2")]
    corpus = [x for _, t in docs for x in words(t)]
    for slop, least in ((0, 0.8), (1, 0.8), (2, 0.9), (1, 1.0)):
        want = set()
        for doc_id, text in docs:
            w = words(text)
            for item_id, t in items:
                k = words(t)
                for s in range(max(1, len(k) - 9) if k else 0):
                    window = k[s : s + 10]
                    need = max(1, -(-round(len(window) * least * 1000) // 1000))
                    order = sorted(range(len(window)), key=lambda j: (corpus.count(window[j]), window[j], j))[: len(window) - need + 1]
                    starts = {p - j for j in order for p, x in enumerate(w) if x == window[j]}
                    if any(sum(x in w[max(0, d + j - slop) : max(0, d + j + slop + 1)] for j, x in enumerate(window)) >= need for d in starts):
                        want.add((doc_id, item_id, s))
        frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id, r.window) for r in proximity_matches(*frames, slop, least=least).collect()}
        assert got == want and (len(want) > 20 or least == 1.0)
