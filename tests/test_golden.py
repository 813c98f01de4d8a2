"""Rules over literal rows: hits, misses, CJK text, nulls; the demanded results stand beside the rows."""

from __future__ import annotations

import duckdb
import pytest

from tests.golden import QUERIES
from tests.test_catalog import canonical


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rule(spark, name):
    run, sql = QUERIES[name]
    df = run(spark, "")
    cursor = duckdb.execute(sql)
    assert canonical(df.columns, df.collect()) == canonical([c[0] for c in cursor.description], cursor.fetchall())
