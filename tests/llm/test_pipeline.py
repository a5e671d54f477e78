import corpus_pipeline

import __spark_entry__ as entry
from reviewloom.llm.store import staged

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "pseudonyms", "packing"]


def test_stages_keep_the_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER), name)
        after = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == columns and len(after) == len(set(after)) and set(after) <= before
        before = set(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == before
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0
