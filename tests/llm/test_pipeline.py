import corpus_pipeline
from verdigraph.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = stored(docs, "test")
        counts.append(docs.count())
    # So few labels as these tables have need not reject anything.
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] > 0
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in tokens.select("doc_id").collect()} == ids


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0, name
