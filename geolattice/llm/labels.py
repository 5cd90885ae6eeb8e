"""Bounded labelled samples for fitting classifiers, and weighted logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import materialize


def draw_labelled(
    docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", unlabelled: bool = False, largest: bool = True, salt: int = 7
) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
    """A sample of whole texts by label: ((id, text, label), share drawn by label, rows by label).

    Rows are known by a hash of id and text. At most about ``most`` different rows of each label
    are drawn, by that hash, so the number is binomial around the bound and memory is bounded
    with it, however often an id or a row repeats; rows by label are estimates of the number of
    different rows, within two percent or so. Labels meet ids and hashes alone; only the drawn
    hashes, a bounded table, are broadcast to fetch texts. Where labels repeat an id the
    largest (or smallest) counts; NULL labels are none. With ``unlabelled`` all rows, whether
    they have a label or not, are drawn from once more, as label -1. NULL texts count as empty.
    """
    best = F.max(label) if largest else F.min(label)
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(best.cast("int").alias("label"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"))
    known = rows.select("id", "h").join(marks, "id").select("h", "label")
    if unlabelled:
        known = known.union(rows.select("h", F.lit(-1)))
    known = materialize(known, "label-rows")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return rows.select("id", "text").limit(0).withColumn("label", F.lit(0)), {}, {}
    spread = 1 << 30
    cuts = {k: min(spread, int(most * spread / max(1, n))) for k, n in counts.items()}
    cut = F.element_at(F.create_map(*[F.lit(x) for k, c in cuts.items() for x in (k, c)]), F.col("label"))
    drawn = materialize(known.filter(F.pmod(F.xxhash64(F.lit(salt), "h", "label"), F.lit(spread)) < cut).distinct(), "drawn-rows")
    found = rows.join(F.broadcast(drawn), "h").dropDuplicates(["h", "label"]).select("id", "text", "label")
    return found, {k: c / spread for k, c in cuts.items()}, counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, coefficients, intercept) of a ridge logistic regression, by Adam on all rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w = weight / weight.sum()
    share = float(np.clip((w * y).sum(), 1e-4, 1 - 1e-4))
    theta = np.zeros(z.shape[1] + 1)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        error = w * (sigmoid(np.einsum("ij,j->i", z, theta[:-1]) + theta[-1]) - y)
        slope = np.append(np.einsum("ij,i->j", z, error) + penalty * theta[:-1] / len(y) ** 0.5, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return mean, scale, theta[:-1], float(theta[-1])
