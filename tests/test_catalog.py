"""Each query of the catalogue against its SQL twin."""

import duckdb
import pytest

from ordinate import catalog, catalog_plans

QUERIES, ORACLE = catalog.QUERIES | catalog_plans.QUERIES, catalog.ORACLE | catalog_plans.ORACLE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, str) else round(float(v), 4) + 0.0


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


def close(a, b):
    if isinstance(a, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b if isinstance(a, str) else abs(a - b) <= 2e-4 * (1 + abs(b))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, sf_dir, name):
    columns, got = rows(QUERIES[name](spark, sf_dir).toPandas())
    wanted_columns, wanted = rows(duck.sql(ORACLE[name]).df())
    assert columns == wanted_columns
    assert len(got) == len(wanted)
    assert all(close(a, b) for a, b in zip(got, wanted))


def test_each_query_has_its_twin():
    assert QUERIES.keys() == ORACLE.keys()
