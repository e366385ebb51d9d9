"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import os

import pytest
from check_queries import compare, connect

import corpus_pipeline
from axisloom.llm.queries import QUERIES, SQL, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, SF).select("doc_id").toPandas()
    assert sorted(got.doc_id) == sorted(table(spark, SF, "documents").toPandas().doc_id)


def test_held_out_accuracy(spark):
    got = QUERIES["op1_quality_trees"](spark, "/root/testdata/sf0.01").toPandas()
    labels = table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == columns
            assert name == "mixture" or docs.count() <= before
        before = docs.count()
    mix = spark.read.parquet(str(tmp_path / "mixture"))
    assert docs.count() == mix.count()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(whole.doc_id, whole.n_tokens)) == sorted((r.doc_id, r.n_tokens) for r in docs.collect())
