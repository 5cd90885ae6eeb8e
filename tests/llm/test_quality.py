"""Quality: the non-negative risk, held-out accuracy, edge cases."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice.llm.common import in_fold
from geolattice.llm.labels import draw_labelled
from geolattice.llm.quality import FEATURES, estimate_prior, features, fit_quality, mixture_prior, mixture_share, nn_pu_risk, score_quality
from geolattice.llm.queries import q06_quality


def test_risk_matches_its_definition():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, 50), rng.normal(0, 1, 70)
    loss = lambda z: np.log(1 + np.exp(-z))
    plus, minus = nn_pu_risk(p, u, 0.4)
    assert plus == pytest.approx(0.4 * loss(p).mean())
    assert minus == pytest.approx(loss(-u).mean() - 0.4 * loss(-p).mean())


def test_prior():
    assert estimate_prior(80, 20) == pytest.approx(81 / 102)
    assert estimate_prior(10, 0) == 0.8


def corpus(spark, n=1200):
    rng = random.Random(8)
    words = ["".join(rng.choices("kamitoru", k=rng.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(15, 90))
        good = rng.random() < 0.8
        if not good:
            text = rng.choice([[w + "***" for w in text], [w.upper() + "!!" for w in text], [text[0]] * 60, " | ".join(text).split()])
        rows.append((i, " ".join(text), int(good)))
        if rng.random() < 0.5:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, truth int"), spark.createDataFrame([*labels, (3, None)], "doc_id long, quality int")


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus(spark)
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit_quality(docs.filter(~held_out), labels.filter(~held_out))
    got = score_quality(docs.withColumn("score", F.lit(9)), model).join(docs.select("doc_id", "truth"), "doc_id").filter(held_out).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert len(got) > 150 and sum(r.predicted == r.truth for r in got) >= 0.93 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 300_000), (3, "a" * 300_000), (None, "kamito")], "doc_id long, text string")
    scores = sorted((r.doc_id or 0, r.score) for r in score_quality(odd, model).collect())
    assert len(scores) == 5 and all(0 <= s <= 1 for _, s in scores) and scores[1][1] == scores[2][1]
    assert score_quality(docs.limit(0), model).collect() == []


def test_without_positives_the_prior_is_the_score(spark):
    docs, labels = corpus(spark, 30)
    model = fit_quality(docs, labels.limit(0))
    assert {round(r.score, 6) for r in score_quality(docs, model).collect()} == {0.8}


def test_feature_count():
    assert len(features("Some text.\nMore, of it!")) == len(features("")) == FEATURES


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.85):
        good, bad = lambda n: rng.normal(2.5, 1, (n, 4)), lambda n: rng.normal(-2.5, 1, (n, 4))
        unlabelled = rng.permutation(np.concatenate([good(int(4000 * share)), bad(4000 - int(4000 * share))]))
        assert share - 0.08 < mixture_prior(good(1500), unlabelled) < share + 0.02
    assert mixture_share(np.arange(1.0, 101), np.concatenate([np.arange(1.0, 101), np.zeros(300)])) == pytest.approx(0.25, abs=0.06)


def test_negative_labels_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    some = fit_quality(docs, labels)
    none = fit_quality(docs, labels.filter("quality = 1"))
    assert some.prior == none.prior and np.allclose(some.w1, none.w1)


def test_sample_is_bounded_however_rows_repeat(spark):
    docs = spark.range(4000).selectExpr("cast(0 AS long) doc_id", "concat('text ', id % 1000) text").union(spark.range(1, 500).selectExpr("id doc_id", "concat('other ', id) text"))
    labels = spark.range(500).selectExpr("id doc_id", "1 quality")
    drawn, share, counts = draw_labelled(docs, labels, "quality", 100, unlabelled=True)
    rows = drawn.collect()
    for label in (1, -1):
        mine = [(r.id, r.text) for r in rows if r.label == label]
        assert 60 < len(mine) < 145 and len(set(mine)) == len(mine)
        assert 1400 < counts[label] < 1600 and share[label] == pytest.approx(100 / counts[label], rel=1e-6)


def test_query_against_direct_network(spark, tmp_path):
    docs, labels = corpus(spark, 400)
    extra = spark.createDataFrame([(7001, None, 0), (7002, "", 0), (7003, "kamito " * 20_000, 1)], "doc_id long, text string, truth int")
    docs.union(extra).selectExpr("*", "1 AS score", "'q' AS label").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    m = fit_quality(docs.filter(~held_out), labels.filter(~held_out))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = q06_quality.query(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        z = [min(6.0, max(-6.0, (x - a) / b)) for x, a, b in zip(features(texts[r.doc_id]), m.mean, m.scale, strict=True)]
        hidden = [max(0.0, sum(z[i] * m.w1[i][j] for i in range(FEATURES)) + m.b1[j]) for j in range(len(m.b1))]
        out = sum(h * w for h, w in zip(hidden, m.w2, strict=True)) + m.b2
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, out)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
