"""The registered queries against their SQL, and the pipeline stage by stage."""

import re

import pytest

import corpus_pipeline
from compare import compare, duck
from tabwise.llm import queries as llm
from tabwise.llm.common import table


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, sf, name):
    assert compare(llm.QUERIES[name](spark, sf), duck(sf), llm.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_a_row_per_document_at_least(spark, sf, name):
    assert llm.QUERIES[name](spark, sf).select("doc_id").distinct().count() == table(spark, sf, "documents").count()


def test_names_cover_the_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES) == list(range(1, 14))


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and now, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and len(set(now)) == len(now), name
        ids = set(now)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(ids)
