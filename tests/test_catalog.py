"""Every catalogue query against its SQL, at the smallest scale."""

import duckdb
import numpy as np
import pytest

from causalframe import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.SQL:
        assert got
        return
    rel = sql.sql(catalog.SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)
