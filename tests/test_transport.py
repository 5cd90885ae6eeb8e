"""The transport plan against plain NumPy, pair by pair, over batches that cut pairs; nothing of it is written out."""

import numpy as np
import pytest

from geolattice import scratch
from geolattice.operators import matching


def _plan(s, dustbin, rounds):
    m, n = s.shape
    z = np.full((m + 1, n + 1), dustbin)
    z[:m, :n] = s
    norm = -np.log(m + n)
    mu, nu = np.full(m + 1, norm), np.full(n + 1, norm)
    mu[-1], nu[-1] = np.log(n) + norm, np.log(m) + norm
    v = np.zeros(n + 1)
    for _ in range(rounds):
        u = mu - np.log(np.exp(z + v).sum(axis=1))
        v = nu - np.log(np.exp(z + u[:, None]).sum(axis=0))
    return z + u[:, None] + v - norm


@pytest.mark.parametrize("batch", [7, 10_000])
def test_plan_of_each_pair_without_intermediate_files(spark, monkeypatch, tmp_path, batch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    rng = np.random.default_rng(4)
    tables = {f"p{n}": rng.normal(size=(1 + n % 4, 1 + n % 3)) for n in range(30)} | {"wide": rng.normal(size=(9, 11))}
    rows = [(p, i, j, float(s[i, j])) for p, s in tables.items() for i in range(s.shape[0]) for j in range(s.shape[1])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.pair, r.i, r.j): r.z for r in matching.sinkhorn(spark.createDataFrame(rows, "pair string, i int, j int, score double"), 0.5, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not list(tmp_path.iterdir()) and len(got) == sum((s.shape[0] + 1) * (s.shape[1] + 1) for s in tables.values())
    for p, s in tables.items():
        z = _plan(s, 0.5, 4)
        for (i, j), x in np.ndenumerate(z):
            assert got[p, i if i < s.shape[0] else -1, j if j < s.shape[1] else -1] == pytest.approx(x, abs=1e-12)


def test_a_missing_score_counts_for_nothing_and_nan_shows(spark):
    rows = [(1, 0, 0, None), (1, 0, 1, 0.5), (2, 0, 0, float("nan")), (2, 0, 1, 0.5)]
    got = {(r.pair, r.i, r.j): r.z for r in matching.sinkhorn(spark.createDataFrame(rows, "pair long, i long, j long, score double"), 1.0, 2).collect()}
    want = _plan(np.array([[-np.inf, 0.5]]), 1.0, 2)
    assert got[1, 0, 0] is None and got[1, 0, 1] == pytest.approx(want[0, 1], abs=1e-12) and np.isnan(got[2, 0, 1])
