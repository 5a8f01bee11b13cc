"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their columns."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: Held by tests of their own, or slow on any table.
ELSEWHERE = {"pipeline", "baseline_sari", "mine_pairs"} | {n for n in QUERIES if n.startswith("op") and n not in ORACLES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - ELSEWHERE))
def test_runs(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
