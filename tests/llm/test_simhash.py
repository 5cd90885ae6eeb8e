"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random

import xxhash

from geolattice.llm.simhash import covering_masks, fingerprint, near_duplicates, near_links


def slow_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_covering_masks_drop_all_pairs_of_bits():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    texts = ["", None, "One", "one  TWO", "É é x y", "a b c", " ".join(rng.choice("abcdefg") for _ in range(400)), "x " * 9]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_links_match_all_pairs(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = {0, (1 << 64) - 1}
    for s in seeds:
        values.add(s)
        for _ in range(12):
            s ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(s)
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    place = {s: i for i, s in enumerate(signed)}
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in links:
        a, b = place[u], place[v]
        assert (values[a] ^ values[b]).bit_count() <= 2
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == slow_components(values)


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60)))) for i in range(60)]
    for i in range(60, 120):
        text = rows[rng.randrange(60)][1].split()
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text) if rng.random() < 0.7 else rows[rng.randrange(60)][1].upper()))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "w1 " * 3000), (204, "w1 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id", "'y' AS z")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    prints = [slow_fingerprint(t) for _, t in rows]
    expected = {rows[i][0]: (f"{p:016x}", rows[c][0]) for i, (p, c) in enumerate(zip(prints, slow_components(prints), strict=True))}
    assert got == expected


def test_empty_repeated_and_null_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or -1) for r in near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (True, 0, -1), (True, 0, 1)]


def test_hot_fingerprints_are_looked_up_apart(spark, monkeypatch):
    from geolattice.llm import simhash

    rows = [(i, "the same text again" if i % 3 else f"text number {i} of its own kind {i * 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "HOT_SHARE", 4)
    assert simhash._owners(simhash.fingerprints(docs)).filter("hot").count() == 1
    assert sorted(near_duplicates(docs).collect()) == plain and len(plain) == 300
    assert {r.component_id for r in plain if r.doc_id % 3} == {1}
    kept = simhash.keep_representatives(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in plain})
