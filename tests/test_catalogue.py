"""Every query with an oracle against DuckDB on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from lociflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """The fixture's intermediate tables are made once for all queries."""
    init, held = catalogue.Tables.__init__, {}

    def with_held(self, spark, sf_dir):
        init(self, spark, sf_dir)
        self.held = held.setdefault(sf_dir, {})

    catalogue.Tables.__init__ = with_held
    yield
    catalogue.Tables.__init__ = init


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, data, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    q = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0
