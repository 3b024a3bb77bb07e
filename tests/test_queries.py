"""Every core query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from spelunka.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v if isinstance(v, (bool, int, str, type(None))) else str(v) if not hasattr(v, "as_tuple") else round(float(v), 5)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    if name in catalog.ORACLES:
        rel = db.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == names
        want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in names) for r in rel.fetchall()), key=str)
        assert got == want


def test_contract():
    import __spark_entry__ as e

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and set(catalog.QUERIES) <= set(e.queries())
