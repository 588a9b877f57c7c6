"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sluice.plans import cases, catalogue  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in order)).collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == order
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() >= 0
