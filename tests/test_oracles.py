"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from geolattice.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return str(value)
    return f"{value:.6g}" if isinstance(value, (float, np.floating)) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_an_oracle_runs(spark, duck, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
