"""Every registered query of the core library against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sievekit import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.collect()


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    return str(value) if isinstance(value, list | dict) else value


def connected(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    compare(spark, duck, name, SF)


@pytest.mark.parametrize("name", ["d03_greedy_dedup", "d04_near_duplicates", "j13_near_duplicate_pairs"])
def test_similar_texts_of_a_larger_table(spark, name):
    larger = SF.replace("0.001", "0.01")
    compare(spark, connected(larger), name, larger)


def compare(spark, duck, name, sf):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(ORACLE[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()
