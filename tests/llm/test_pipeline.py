import os

import pytest

import corpus_pipeline
from quillmask.llm import jaccard_join, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    kept = corpus_pipeline.STAGES[1][1](spark, docs, DATA)
    found = {r.doc_id: r.component_id for r in jaccard_join.similar(docs).collect()}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, c in found.items() if d == c) and kept.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    left = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert {r.doc_id for r in left.select("doc_id").collect()} == {d for d, s in scores.items() if s < 0.5}
    masked = corpus_pipeline.STAGES[2][1](spark, docs, DATA)
    assert masked.columns == docs.columns and masked.count() == docs.count() and masked.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
