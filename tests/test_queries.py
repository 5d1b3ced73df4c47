"""Every query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from phrasemill.plans import catalog, pages

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_without_sql(spark, name):
    rows = catalog.queries()[name](spark, DATA).collect()
    assert rows and hasattr(pages, name)
    for r in rows:
        assert all(v is None or 0 <= v <= 1 for k, v in r.asDict().items() if k == "p" or k.endswith(("_p", "p_adjusted")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted([_plain(r[c]) for c in columns] for r in df.collect())
    assert got == sorted([_plain(r[i]) for i in order] for r in want.fetchall())
