"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest
from texelarium.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def _rows(rows, order):
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got, cur = df.collect(), duck.execute(SQL[name])
    names, want = [x[0] for x in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    assert want and _rows(got, [df.columns.index(c) for c in cols]) == _rows(want, [names.index(c) for c in cols])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows and all(r.asDict().get("error") is None for r in rows)
