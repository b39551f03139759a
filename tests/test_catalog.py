"""Every registered query that has SQL, against it."""

import os

import duckdb
import pytest

from seqlake import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return c


def shown(rows):
    return sorted(tuple("NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf)
    if name not in catalog.oracle_sql():
        assert got.count() > 0
        return
    done = con.execute(catalog.oracle_sql()[name])
    names, cols = [c[0] for c in done.description], sorted(got.columns)
    assert sorted(names) == cols
    assert shown(got.select(*cols).collect()) == shown(tuple(r[names.index(c)] for c in cols) for r in done.fetchall())
