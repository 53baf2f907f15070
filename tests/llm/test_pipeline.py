"""Registered queries against their SQL, and the pipeline's stages against plain checks."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline
from check import TABLES, canon
from muster.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    # These two judge pages; all others have at least a row per document.
    source = "pages" if name.startswith(("op4_", "op11_")) else "documents"
    assert len(rows) >= queries.table(spark, sf_dir, source).count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        expected = con.sql(queries.ORACLES[name])
        assert canon(rows, df.columns) == canon(expected.fetchall(), expected.columns)


def test_pipeline(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        now = docs.count()
        assert docs.columns == columns and 0 < now <= before
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()
