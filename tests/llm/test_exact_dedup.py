"""Exact deduplication and its trie against plain dictionaries."""

from __future__ import annotations

import hashlib
import random

from geolattice.llm.exact_dedup import exact_dedup
from geolattice.llm.patricia import PatriciaTrie, flat_members


def test_trie_with_spill_matches_a_dictionary():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) + b"tail" * rng.randint(0, 9) for _ in range(3000)]
    for budget in (1 << 30, 60_000, 20_000):
        trie = PatriciaTrie(budget)
        for i, k in enumerate(keys):
            trie.insert(k, (-i,), 1, i)
        groups = {}
        for i, k in enumerate(keys):
            groups.setdefault(k, []).append(i)
        assert (trie.spills > 0) == (budget < 1 << 30)
        got = sorted((t.best, t.count, tuple(sorted(flat_members(t.members)))) for t in trie.terminals())
        assert got == sorted(((-max(g),), len(g), tuple(sorted(g))) for g in groups.values())


def expected(rows):
    lower = [(i, (t or "").encode().lower()) for i, t in rows]
    out = []
    for i, k in lower:
        ids = [j for j, other in lower if other == k]
        out.append((i, max(ids), len(ids), hashlib.sha256(k).hexdigest()))
    return sorted(out)


def test_documents_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Abc def", "abc DEF", "É", "é", "", None, "x" * 50_000, "x" * 50_001, f"t{i}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS keep_id", "'q' AS _class", "2 AS kept")
    for chunk, budget in ((8 << 20, 96 << 20), (60_000, 5_000)):
        got = exact_dedup(docs, chunk_bytes=chunk, trie_budget=budget).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup(docs, carry=True)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _ in expected(rows)})


def test_smallest_owner_repeats_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "A"), (5, "a"), (None, "a"), (None, "b")], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, keep="smallest").collect() if r.keep_id is not None)
    assert [g[:3] for g in got] == [((False, 1), 1, 4), ((False, 1), 1, 4), ((False, 5), 1, 4), ((True, 0), 1, 4)]
    assert sum(g[3] for g in got) == 1
    alone = [r for r in exact_dedup(docs).collect() if r.keep_id is None]
    assert [(r.doc_id, r.group_size, r.kept) for r in alone] == [(None, 1, True)]
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
