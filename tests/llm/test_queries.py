"""Registered queries against SQL, and the pipeline."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    cell = lambda v: "null" if v is None or str(v) in ("<NA>", "nan") else str(float(v)) if hasattr(v, "real") else str(v)
    text = lambda df: sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))
    assert sorted(want.columns) == columns and text(got) == text(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, kept = docs.schema, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == schema.names
        assert docs.count() <= kept
        kept = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
