"""The pipeline's stages against what their operators say of the same input."""
import corpus_pipeline
from rankloom.llm import crf, decontaminate, ngram_join
from rankloom.llm.scratch import Scratch


def test_stages(spark, sf):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("copies", docs.doc_id).withColumn("score", docs.doc_id)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(scratch.table(stage(spark, seen[-1], sf), name))
    assert all(x.columns == docs.columns for x in seen[:-1]) and seen[-1].columns == [*docs.columns, "mix_copies"]
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert ids[1] == {r.doc_id for r in crf.score_documents(docs.drop("score"), labels).where("predicted = 1").collect()}
    assert ids[2] == {r.doc_id for r in ngram_join.join_documents(seen[1]).where("doc_id = component_id").collect()}
    bad = {r.doc_id for r in decontaminate.contaminated(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - bad and ids[5] <= ids[4]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
