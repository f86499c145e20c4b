import math
from collections import Counter

import duckdb
import pytest

from kairoline import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    a = Counter(str(tuple(map(same, r))) for r in got.select(*(f"`{n}`" for n in names)).collect())
    assert a == Counter(str(tuple(map(same, r))) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
