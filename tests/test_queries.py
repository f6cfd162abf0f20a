"""Every registered query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from quillgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value.normalize()) if isinstance(value, decimal.Decimal) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert found
    if name in catalogue.ORACLES:
        rows = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert found == sorted(tuple(map(plain, r)) for r in rows)


def test_oracles_belong_to_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_pages_that_lie_on_their_side_are_found(spark):
    rows = catalogue.QUERIES["page_turns"](spark, SF).collect()
    assert {r.turn for r in rows if r.doc_id % 10 == 3} == {270} and {r.turn for r in rows if r.doc_id % 10 != 3} == {0}
