"""The pipeline, and that every operator's query is registered."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from ledgerline.llm import queries as Q


def test_registered():
    assert {n for n in entry.queries() if re.match(r"op\d+_", n)} == set(Q.QUERIES)
    assert len(Q.QUERIES) == 10 and "pipeline" in entry.queries()


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)


def test_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, "/root/testdata/sf0.001").count() <= 100 * rows.count(), name
