"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from lodestone import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 5))
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    cursor = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cursor.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want
