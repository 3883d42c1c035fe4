"""Each query against its SQL on the smallest tables, independent of partitioning."""

import glob
import math
import os

import pytest

from orrery import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
