"""The pipeline's stages in order, and every query over its whole table."""

import duckdb
import pytest

import corpus_pipeline
from shelfsight.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_take_rows_away(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == n and last.where("not decoded_equal").count() == 0
    again = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r["doc_id"] for r in again.select("doc_id").collect()) == \
        sorted(r["doc_id"] for r in last.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    names = sorted(got.columns)
    want = db.sql(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())
