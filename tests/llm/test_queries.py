"""Registered queries against their SQL, and the pipeline against what its stages promise."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op9_line_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).values.tolist())) == sorted(map(tuple, want.astype(str).values.tolist()))


def test_queries_return_every_row(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    table = {"op4": "embeddings", "op6": "pages"}
    for name, f in entry.queries().items():
        op = name.split("_")[0]
        if op in ("op2", "op4", "op6", "op7", "op8", "op10"):
            assert f(spark, SF).count() == rows[table.get(op, "documents")], name


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and docs.count() <= left
        left = docs.count()
    assert docs.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count() == 0
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == left
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert p.run(spark, SF).count() == packed.count()
