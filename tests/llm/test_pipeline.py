"""The pipeline from raw documents to packed sequences, and each stage on what the one before kept."""

import pytest

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_keeps_the_columns_of_documents_and_adds_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.select("doc_id").distinct().count() == out.count() <= seen
        docs = pipeline.stored(out, "stage")
        seen = docs.count()
    assert seen
    packed = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == seen


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_a_stage_takes_an_empty_table(spark, name, stage):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert stage(spark, empty, FOLDER).count() == 0
