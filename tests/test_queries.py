"""Every transit query against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from tramline.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 6)
        return v.date() if isinstance(v, datetime.datetime) and v.time() == datetime.time() else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sql, name):
    out = registry.QUERIES[name](spark, DATA)
    names = sorted(out.columns)
    want = sql.sql(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({registry.SQL[name]})")
    assert plain(tuple(r) for r in out.select(names).collect()) == plain(want.fetchall())
