"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from recurra import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda x: f"{x:.5g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in found), sorted(names)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = rows(df.collect(), df.columns)
    if name in Q.ORACLES:
        found = duck.execute(Q.ORACLES[name])
        names = [d[0] for d in found.description]
        assert got == rows(found.fetchall(), names)
    assert got[1]


def test_entry_works_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
