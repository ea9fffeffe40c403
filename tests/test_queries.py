"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    try:
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        r = con.sql(ORACLES[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
    else:
        assert got
