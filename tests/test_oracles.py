"""Every layout query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
SKIP = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(records, names):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}" if v % 1 else str(int(v))
        return str(v)

    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in records), sorted(names)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@SKIP
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert got == rows(want.fetchall(), want.columns)


@SKIP
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
