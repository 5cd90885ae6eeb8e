"""The backoff model against a direct implementation over dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolattice.llm import katz


def words(text):
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()] + ["</s>"]


class SlowKatz:
    """Katz backoff over tuples of words, evaluated by recursion."""

    def __init__(self, texts, order=2):
        self.order = order
        docs = [["<s>"] * (order - 1) + words(t) for t in texts]
        self.c, self.ch, self.after = defaultdict(Counter), Counter(), defaultdict(list)
        for d in docs:
            for i in range(order - 1, len(d)):
                for k in range(1, order + 1):
                    self.c[k][tuple(d[i - k + 1 : i + 1])] += 1
        for k in range(2, order + 1):
            for gram, n in self.c[k].items():
                self.ch[gram[:-1]] += n
                self.after[gram[:-1]].append(gram[-1])
        self.c1 = Counter({g[0]: n for g, n in self.c[1].items()})
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]
        self.d = {k: katz.discounts(of(self.c[k])) for k in range(1, order + 1)}
        self.unknown = 1 - sum(self.star(c, 1) for c in self.c1.values()) / self.n if self.n else 1.0
        self.weights = {}

    def star(self, c, k):
        return c * self.d[k][c] if c <= katz.CUT else c - katz.FLOOR

    def p(self, history, w):
        if not history:
            return self.star(self.c1[w], 1) / self.n if self.c1[w] else self.unknown
        k = len(history) + 1
        if not self.ch[history]:
            return self.p(history[1:], w)
        if self.c[k][(*history, w)]:
            return self.star(self.c[k][(*history, w)], k) / self.ch[history]
        if history not in self.weights:
            free = 1 - sum(self.star(self.c[k][(*history, x)], k) for x in self.after[history]) / self.ch[history]
            self.weights[history] = free / (1 - sum(self.p(history[1:], x) for x in self.after[history]))
        return self.weights[history] * self.p(history[1:], w)

    def score(self, text):
        d = ["<s>"] * (self.order - 1) + words(text)
        return sum(math.log10(self.p(tuple(d[i - self.order + 1 : i]), d[i])) for i in range(self.order - 1, len(d)))


def corpus(n=150):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, " \t\x0b\x0c\r\n"), (903, "É é\x85x\xa0y\x1cz W0 w0"), (904, "never seen words"), (905, "w0 " * 30_000), (905, "w0 " * 30_000)]
    return rows


@pytest.mark.parametrize(("order", "chunk", "range_bytes"), [(2, 28 << 20, 1 << 20), (2, 2000, 20_000), (3, 28 << 20, 1 << 20), (3, 2000, 60_000), (1, 2000, 20_000), (4, 3000, 100_000)])
def test_scores_against_direct_model(spark, order, chunk, range_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS train", "'x' AS score")
    held = lambda i: i % 4 == 1 or i == 904
    train = ~((F.col("doc_id") % 4 == 1) | (F.col("doc_id") == 904))
    model = SlowKatz([t for i, t in rows if not held(i)], order)
    got = katz.score_katz(docs, train, order=order, chunk_text=chunk, range_bytes=range_bytes).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        w = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(model.c1[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10((model.c1[x] + 1) / (model.n + model.v + 1)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_direct_model_is_normalised(order):
    model = SlowKatz([t for _, t in corpus(60)], order)
    histories = [("<s>",), ("w0",), ("w5",), ("w40",), ("absent",)] if order == 2 else [("<s>", "<s>"), ("<s>", "w0"), ("w0", "w0"), ("w1", "w3"), ("absent", "w0"), ("w2", "absent")]
    for h in histories:
        assert sum(model.p(h, w) for w in model.c1) + model.p(h, "unseen word") == pytest.approx(1)


def test_longer_order_tells_seen_texts_apart(spark):
    rng = random.Random(4)
    draw = lambda: " ".join(rng.choices([f"v{i}" for i in range(30)], k=40))
    twice, rows = [draw() for _ in range(20)], []
    for i, t in enumerate(twice):
        rows += [(10 * i, t), (10 * i + 2, t), (10 * i + 1, t)]
    rows += [(1000 + i, draw()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") % 10 != 1
    mean = lambda order, ids: np.mean([r.score / r.n_tokens for r in katz.score_katz(docs, train, order=order).filter(ids).collect()])
    seen, unseen = "doc_id < 1000 AND doc_id % 10 = 1", "doc_id >= 1000 AND doc_id % 10 = 1"
    assert mean(3, seen) - mean(3, unseen) > mean(2, seen) - mean(2, unseen) + 0.2


def test_no_training_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")
    got = katz.score_katz(docs, F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert sorted(r.doc_id or 0 for r in got) == [0, 1]
    assert katz.score_katz(docs.limit(0), F.lit(True)).collect() == []


def test_arrays_survive_packing():
    arrays = [np.array([], dtype=np.uint64), np.array([1, 300], dtype=np.uint16), np.arange(9, dtype=np.int64), np.array([2**64 - 1], dtype=np.uint64)]
    for a, b in zip(arrays, katz.unpack_arrays(katz.pack_arrays(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
