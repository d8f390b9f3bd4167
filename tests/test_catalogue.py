"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalogue, corpus_queries, judging_queries, report_queries  # noqa: F401
from tests.conftest import SF


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), columns)
