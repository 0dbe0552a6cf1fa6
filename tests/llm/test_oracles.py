"""The operators that SQL expresses give its rows."""

from collections import Counter

import duckdb
import pytest

from flowbook.llm import queries as L
from flowbook.llm.oracle import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_the_sql(spark, duck, name):
    df = L.QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    cols = sorted(names)
    assert sorted(df.columns) == cols
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == want
