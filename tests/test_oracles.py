"""Every query of the library that has SQL, held against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal

import duckdb
import pytest

from parley import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
plans.load_all()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return int(x) if x.is_integer() else round(x, 9)
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    got = df.collect()
    if name not in plans.ORACLES:
        assert got or name == "speech_utterances"
        return
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(names, found.fetchall())
