from test_covering import brute_kept

import corpus_pipeline
from tallyspark.llm import decontaminate, quality


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        assert [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        kept.append(docs.count())
        steps[name] = (before, docs)
    before, after = steps["quality"]
    model = quality.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in quality.scored(before, model).where("score >= 0.5").collect()}
    before, after = steps["near_duplicates"]
    assert {r["doc_id"] for r in after.collect()} == brute_kept([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()])
    before, after = steps["decontamination"]
    bad = {r["doc_id"] for r in decontaminate.contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    assert kept[4] == kept[3] and kept[0] > kept[1] > kept[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_nothing_to_do(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "Some text here. " * 40, None, "s", 1)], schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.count() == (2 if name != "packing" else 2), name
