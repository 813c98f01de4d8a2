"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return "None" if isinstance(value, float) and math.isnan(value) else f"{float(value):.9g}"
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and got is not None
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, got) == canonical(names, cursor.fetchall())
