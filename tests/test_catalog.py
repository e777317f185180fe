"""Every query runs on the smallest tables; where there is SQL, values agree with DuckDB."""

import os

import duckdb
import pytest

from waygraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else str(x) if x is not None else None for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.SQL:
        return
    rel = duck.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((plain([r[names.index(c)] for c in cols]) for r in rel.fetchall()), key=repr)
    assert got == want
