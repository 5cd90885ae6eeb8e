"""Quality scores from positive-unlabelled learning.

Trusted positives and unlabelled web text, never labelled negatives, train a small network by
minimising the non-negative unbiased risk: with class prior p and loss l,
p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)]). Unlabelled text is a sample of all rows.
The prior is estimated from the two samples alone: classifiers tell positives from unlabelled
text, and among the rows they rank highest the shares of both are compared (best bin estimation).
Rows are scored by themselves; nothing shuffles but the bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import materialize, small_slices
from geolattice.llm.labels import draw_labelled, fit_logistic, sigmoid

HIDDEN = 48

#: Byte classes: lower case, upper case, digits, blanks, line feeds, sentence marks, quotes and brackets, other marks, high bytes, control.
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[128:] = 8
_CLASS[:32] = 9
_CLASS[127] = 9
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13]] = 3, 4
_CLASS[list(b".,;:!?-")] = 5
_CLASS[list(b"\"'()[]")] = 6
CLASSES = 10
FEATURES = CLASSES + 12


def features(text: str) -> list[float]:
    """Shares of byte classes, repetition, word shapes and lengths of a whole text."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * FEATURES
    n = len(raw)
    classes = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=CLASSES)[:CLASSES] / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x]
    packed = len(zlib.compress(raw, 1)) / (n + 20)
    marks = raw.count(b"!") / m, raw.count(b"|") / m, (raw.count(b"*") + raw.count(b"#") + raw.count(b"%") + raw.count(b"&") + raw.count(b"$")) / m
    return [
        *classes.tolist(),
        len(set(words)) / m,
        sum(map(eq, words, words[1:])) / m,
        float(sizes.mean()) / 10,
        float(sizes.std()) / 10,
        float(sizes.max()) / 100,
        float(np.log1p(m)),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        packed,
        *marks,
    ]


@dataclass(frozen=True)
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        hidden = np.maximum(0.0, np.einsum("ij,jk->ik", z, self.w1) + self.b1)
        return sigmoid(np.einsum("ij,j->i", hidden, self.w2) + self.b2)


def nn_pu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part before it is held at zero) of the unbiased risk with logistic loss, from raw outputs."""
    plus, minus = np.log1p(np.exp(-np.clip(positive, -40, 40))), np.log1p(np.exp(np.clip(positive, -40, 40)))
    return prior * float(plus.mean()), float(np.log1p(np.exp(np.clip(unlabelled, -40, 40))).mean()) - prior * float(minus.mean())


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1600, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4, seed: int = 5) -> QualityModel:
    """Trains the network by Adam on mini-batches.

    Batches are drawn with replacement, ``steps`` of them whatever the number of rows. Where a batch's negative part falls under zero, the step undoes that part (its gradient is
    followed upwards) instead of fitting it further.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    scale[scale < 1e-9] = 1.0
    p, u = np.clip((positive - mean) / scale, -6, 6), np.clip((unlabelled - mean) / scale, -6, 6)
    k = p.shape[1]
    theta = [rng.normal(0, (2 / k) ** 0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.array(0.0)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        xu, xp = u[rng.integers(0, len(u), batch)], p[rng.integers(0, len(p), batch)]
        x = np.concatenate([xp, xu])
        pre = np.einsum("ij,jk->ik", x, theta[0]) + theta[1]
        hidden = np.maximum(0.0, pre)
        out = np.einsum("ij,j->i", hidden, theta[2]) + theta[3]
        fp, fu = out[: len(xp)], out[len(xp) :]
        _, negative = nn_pu_risk(fp, fu, prior)
        on_u, minus_p, plus_p = sigmoid(fu) / len(fu), -prior * sigmoid(fp) / len(fp), -prior * sigmoid(-fp) / len(fp)
        if negative >= 0:
            slope = np.concatenate([plus_p + minus_p, on_u])
        else:
            slope = np.concatenate([-minus_p, -on_u])
        back = np.outer(slope, theta[2]) * (pre > 0)
        grads = [np.einsum("ij,ik->jk", x, back) + decay * theta[0], back.sum(axis=0), np.einsum("ij,i->j", hidden, slope) + decay * theta[2], slope.sum()]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(prior, mean, scale, theta[0], theta[1], theta[2], float(theta[3]))


def estimate_prior(positives: int, negatives: int, fallback: float = 0.8) -> float:
    """Share of positives from counts of labelled rows of both kinds, for callers who have them and pass ``prior``; ``fallback`` without negatives."""
    if not negatives:
        return fallback
    return float(np.clip((positives + 1) / (positives + negatives + 2), 0.02, 0.98))


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among unlabelled rows from the ranks that a classifier gives to both.

    Above a threshold lie a share a of the positives and b of the unlabelled rows, and as
    unlabelled text is a mixture, the share is b / a at most. The threshold is that of the least
    upper bound of b / a, with deviations that hold at ``confidence``.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    wide = lambda n: np.sqrt(np.log(4 / confidence) / (2 * n))
    best = int(((above_u + wide(len(u)) + wide(len(p))) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def mixture_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 800) -> float:
    """Class prior from features of positives and unlabelled rows alone, without any negative.

    A logistic regression between both gives a first estimate; the network fitted with nine
    tenths of it ranks better and gives the second. Both are fitted on every other row and
    estimate on the rest. One standard error and two thirds are taken off, as too large a prior
    switches the negative part of the risk off, while one that is somewhat small does no harm.
    """
    half = lambda rows, at: rows[at::2] if len(rows) > 1 else rows
    p, u = half(positive, 0), half(unlabelled, 0)
    x, y = np.concatenate([p, u]), np.append(np.ones(len(p)), np.zeros(len(u)))
    mean, scale, theta, _ = fit_logistic(x, y, np.where(y == 1, 1 / len(p), 1 / len(u)))
    rank = lambda rows: np.einsum("ij,j->i", np.clip((rows - mean) / scale, -6, 6), theta)
    rest_p, rest_u = half(positive, 1), half(unlabelled, 1)
    first = mixture_share(rank(rest_p), rank(rest_u))
    network = fit_pu(p, u, 0.9 * first, steps)
    second = min(first, mixture_share(network.score(rest_p), network.score(rest_u)))
    return max(0.02, second - 5 / 3 * float(np.sqrt(second * (1 - second) / len(rest_u))))


def _scored(model: QualityModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            x = np.array([features(t.as_py() or "") for t in batch.column("text")], dtype=float).reshape(-1, FEATURES)
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            last = ("x", pa.array(x.tolist(), pa.list_(pa.float64()))) if model is None else ("score", pa.array(model.score(x)))
            yield pa.RecordBatch.from_arrays([*kept, last[1]], names=[*names, last[0]])

    return run


def fit_quality(train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = 12_000, prior: float | None = None) -> QualityModel:
    """Fits from at most about ``sample_rows`` trusted positives and as many rows of unlabelled text.

    ``train`` holds the rows to learn from; unlabelled text is drawn from all of them, and what
    labels other than 1 say is not used. A NULL label is no label; where labels repeat an id the
    smallest counts. The prior is estimated by ``mixture_prior`` unless given. Without positives
    the score is the prior everywhere, 0.8 unless given.
    """
    drawn, _, _ = draw_labelled(train, labels, label, sample_rows, id_col, text_col, unlabelled=True, largest=False)
    seen = materialize(drawn.filter("label IN (1, -1)").select("text", "label").mapInArrow(_scored(None), "label int, x array<double>"), "quality-sample").collect()
    positive, unlabelled = (np.array(sorted(r.x for r in seen if r.label == k), dtype=float).reshape(-1, FEATURES) for k in (1, -1))
    if not len(positive) or not len(unlabelled):
        p = estimate_prior(0, 0) if prior is None else prior
        return QualityModel(p, np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(p / (1 - p))))
    shuffle = np.random.default_rng(3)
    positive, unlabelled = shuffle.permutation(positive), shuffle.permutation(unlabelled)
    return fit_pu(positive, unlabelled, mixture_prior(positive, unlabelled) if prior is None else prior)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Scores every whole text.

    Returns one row per input row: ``id_col``, score (0 to 1, higher: more likely good),
    predicted (1 from ``threshold`` on). NULL texts count as empty and are scored too. Texts of
    any length are scored whole. NULL
    and repeated ids come back as they are; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(_scored(model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
