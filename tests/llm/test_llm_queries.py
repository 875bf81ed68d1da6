"""Registered queries of the package: SQL twins, whole tables, the pipeline."""

import pytest
from compare import connect, differences

import corpus_pipeline
from plumbline.llm import queries
from plumbline.plans.session import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_every_row_has_a_result(spark, name):
    """No row is lost, none is made up; a document of several pieces counts once."""
    ids = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    found = queries.QUERIES[name](spark, FOLDER)
    found = materialize((found.where("piece = 0") if "piece" in found.columns else found).select("doc_id"), name)
    assert found.exceptAll(ids).count() == ids.exceptAll(found).count() == 0


def test_pipeline(spark):
    """Stage by stage: what goes, what stays, and what the last stage packs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, FOLDER), name)
        assert docs.columns == before.columns
        if name == "ngram_jaccard_join":
            assert docs.count() < before.count()
        if name in ("suffix_array_dedup", "pii"):
            assert docs.count() == before.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.where("text like '%[EMAIL]%' or text like '%[CARD]%' or text like '%[IP]%'").count() > 0
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
