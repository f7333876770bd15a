import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
NAMES = [n for n in e.oracle_sql() if not n.startswith("op")]


def compare(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = e.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(e.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    a = sorted(str(tuple(r)) for r in got.select(*cols).toPandas().astype(str).itertuples(index=False))
    b = sorted(str(tuple(r)) for r in want[cols].astype(got.toPandas().dtypes.to_dict()).astype(str).itertuples(index=False))
    assert a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    compare(spark, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0
