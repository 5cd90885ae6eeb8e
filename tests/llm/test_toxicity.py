"""Toxicity: the automaton against edit distances, quotation, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from geolattice.llm.common import in_fold
from geolattice.llm.queries import q07_toxicity
from geolattice.llm.toxicity import ADDRESSING, REPORTING, WINDOW, WORD, LevenshteinAutomaton, LexiconTrie, Matcher, Shortened, ToxicityModel, fit_toxicity, is_quoted, masked, misspelled, mixed_tokens, score_toxicity


def distance(a, b):
    """Edit distance with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_exactly_what_is_within_one_edit():
    rng = random.Random(1)
    lexicon = {"".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(25)}
    trie = LexiconTrie(lexicon)
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(0, 7)))
        near = sorted((distance(word, t), t) for t in lexicon if distance(word, t) <= 1)
        found = trie.find(word)
        assert (found is None) == (not near)
        if found:
            assert found[1] == near[0][0] and distance(word, found[0]) == found[1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_automaton_for_any_number_of_edits(most):
    rng = random.Random(most)
    lexicon = {"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(40)}
    trie = LexiconTrie(lexicon)
    for _ in range(600):
        word = "".join(rng.choices("abcd", k=rng.randint(0, 8)))
        near = sorted((d, t) for t in lexicon if (d := distance(word, t)) <= most)
        assert trie.find(word, most) == ((near[0][1], near[0][0]) if near else None)
        automaton, other = LevenshteinAutomaton(word, most), rng.choice(sorted(lexicon))
        state = automaton.start
        for c in other:
            state = automaton.step(state, c) if state else None
        assert (automaton.edits(state) if state else None) == (distance(word, other) if distance(word, other) <= most else None)


@pytest.mark.parametrize("most", [1, 2])
def test_no_near_word_is_ruled_out(most):
    rng = random.Random(5)
    lexicon = {"".join(rng.choices("abcde", k=rng.randint(4, 8))) for _ in range(12)}
    known, ruled_out = Shortened(lexicon, most), 0
    for _ in range(6000):
        word = "".join(rng.choices("abcdef", k=rng.randint(3, 9)))
        if not known.may_match(word):
            ruled_out += 1
            assert min(distance(word, t) for t in lexicon) > most
    assert ruled_out > 500


def test_digits_and_marks_for_letters(spark):
    text = "id1ot cl0wn tr@sh m0ron w0rthless stup1d 12 abc you!idiot a1 idiot! $cum *no* _x1 +b2!"
    found = mixed_tokens(text)
    assert [t for _, _, t in found] == ["id1ot", "cl0wn", "tr@sh", "m0ron", "w0rthless", "stup1d", "you!idiot", "a1", "$cum", "b2"]
    assert all(text[a:z] == t for a, z, t in found)
    model = ToxicityModel({t: 5.0 for t in ("idiot", "clown", "trash", "moron", "worthless", "stupid", "scum")}, ())
    matcher = Matcher(model)
    for w in ("id1ot", "cl0wn", "tr@sh", "m0ron", "w0rthless", "stup1d", "idoit", "morron"):
        assert matcher.kind(w)[1] == 2, w
    assert matcher.kind("scvm")[1] == 3 and matcher.kind("scum")[1] == 0 and matcher.kind("kamito") is None
    assert masked("Idiot and scum, kamito", model.terms) == "Id1ot and sc*m, kamito"
    docs, labels = corpus(spark)
    fitted = fit_toxicity(docs, labels)
    odd = spark.createDataFrame([(1, "you gr*mpf and vl0rba kamito id1ot"), (2, "kamito rumi")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in score_toxicity(odd, fitted).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_query_against_direct_scores(spark, tmp_path):
    docs, labels = corpus(spark, 200)
    odd = [(901, None), (902, ""), (903, "he wrote: you idiot"), (904, "you id1ot, grumpff! vlorbek"), (905, "kamito \"grumpf\" rumi " * 3000), (906, "vlorbek " * 50_000)]
    docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS score", "2 AS label").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    m = fit_toxicity(docs.filter(~held_out), labels.filter(~held_out))
    terms = [t for t in {*m.terms, *m.sure} if len(t) >= 4]

    def kind(w):
        if w in m.terms:
            return m.terms[w], 0
        if any(w.startswith(s) for s in m.stems):
            return 1.0, 1
        near = min(((distance(w, t), t) for t in terms if abs(len(t) - len(w)) <= 1), default=(9, ""))
        return (m.terms.get(near[1], 5.0), 2 if near[1] in m.sure and len(near[1]) >= 5 else 3) if near[0] <= 1 else None

    seen = {}

    def direct(text):
        low, hits, quoted, addressed = text.lower(), [], 0, 0
        for start, end, word in [*((f.start(), f.end(), f.group()) for f in WORD.finditer(low)), *mixed_tokens(low)]:
            if word not in seen:
                seen[word] = kind(word)
            if (k := seen[word]) is None:
                continue
            before, after = low[max(0, start - WINDOW) : start], low[end : end + WINDOW]
            marks = sum(c in '"“”„«»' for c in before)
            if any(re.search(rf"\b{v}\b", before) for v in REPORTING) or (marks % 2 and any(c in '"“”„«»' for c in after)):
                quoted += 1
                continue
            hits.append((word, *k))
            addressed += k[1] < 3 and any(re.search(rf"\b{v}\b", low[max(0, start - WINDOW) : end + WINDOW]) for v in ADDRESSING)
        if not hits and not quoted:
            return [0.0] * 10
        n = [sum(h[2] == k for h in hits) for k in range(4)]
        told = n[0] + n[1]
        return [*map(math.log1p, n), math.log1p(quoted), max((h[1] / (1 + h[2]) for h in hits), default=0.0), math.log1p(len({h[0] for h in hits if h[2] < 2})), math.log1p(100 * told / max(1, len(WORD.findall(low)))), math.log1p(addressed), float(told > 0)]

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = q07_toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        z = sum((x - a) / b * w for x, a, b, w in zip(direct(texts[r.doc_id]), m.mean, m.scale, m.weights, strict=True)) + m.intercept
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), abs=1e-9), texts[r.doc_id][:80]
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quotation():
    text = 'he wrote that idiot is a word. "such a moron" they laughed. you idiot'
    assert is_quoted(text, text.index("idiot"), text.index("idiot") + 5)
    assert is_quoted(text, text.index("moron"), text.index("moron") + 5)
    assert not is_quoted(text, text.rindex("idiot"), len(text))


def corpus(spark, n=400):
    rng = random.Random(3)
    clean = ["".join(rng.choices("kamitoru", k=rng.randint(4, 9))) for _ in range(300)]
    bad = ["vlorb" + s for s in ("a", "ek", "una", "is", "ot")] + ["grumpf", "idiot"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randint(10, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (9999, 1)], "doc_id long, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus(spark)
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit_toxicity(docs.filter(~held_out), labels)
    assert "grumpf" in model.terms and any(s.startswith("vlor") for s in model.stems)
    got = score_toxicity(docs.withColumn("score", F.lit(1)), model).join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(held_out).collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, "you are a grumfp and a grumpff kamito"), (2, "kamito rumi"), (3, None), (3, ""), (None, "vlorbek vlorba grumpf " * 4000)], "doc_id long, text string")
    bent = misspelled("A grumpf and an idiot, fine", model.terms)
    assert bent != "A grumpf and an idiot, fine" and sorted(bent) == sorted("A grumpf and an idiot, fine")
    scores = {(r.doc_id or 0): r.score for r in score_toxicity(odd, model).collect()}
    assert scores[1] > scores[2] == scores[3] and scores[0] > 0.5
    assert score_toxicity(docs.limit(0), model).collect() == []


def test_one_label_or_none_falls_back_to_the_seed_terms(spark):
    docs, labels = corpus(spark, 20)
    for some in (labels.filter("toxic = 0"), labels.limit(0)):
        model = fit_toxicity(docs, some)
        assert isinstance(model, ToxicityModel) and "idiot" in model.terms
        assert score_toxicity(docs, model).count() == 20
