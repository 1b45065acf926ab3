import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality, queries


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 200
    rows = quality.scored(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows])
    assert right > 0.95


def test_column_and_matrix_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(int)
    model = quality.fit(x, y)
    got = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i int, s array<double>").select("i", model.score(F.col("s")).alias("p")).orderBy("i").collect()
    assert np.allclose([r["p"] for r in got], model.scores(x), atol=1e-9)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97


def test_few_labels():
    assert quality.fit(np.zeros((0, len(quality.STATS))), np.zeros(0)).bias == 0
    assert quality.fit(np.zeros((50, len(quality.STATS))), np.ones(50)).rules == []


@pytest.mark.parametrize("text", ["", " \n ", "a", "x" * 100_000, "Ünïcode | | |", "a b " * 50_000])
def test_statistics_are_finite(text):
    got = quality.statistics(text.encode())
    assert len(got) == len(quality.STATS) and np.isfinite(got).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0, 1), (None, "", 2.0, 2), (1, "Good text. " * 30, None, 3), (1, "Good text. " * 30, None, 3)], "doc_id long, text string, score double, _stats int")
    model = quality.RuleModel(1.0, [((0, True, 3.0),)], [-4.0])
    got = quality.scored(docs, model)
    assert got.columns == docs.columns
    assert sorted(round(r["score"], 6) for r in got.collect()) == [0.047426, 0.047426, 0.731059, 0.731059]
    assert quality.accepted(docs, model).count() == 2
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels).score(F.array()) is not None
    assert quality.scored(docs.limit(0), model).count() == 0


def test_query_by_a_plain_account(spark, sf_dir):
    """Each document of the table: its score from its statistics and the learnt rules, one at a time."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    rows = queries.op1_quality(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        stats = quality.statistics(texts[r["doc_id"]].encode())
        total = model.bias
        for rule, weight in zip(model.rules, model.weights):
            if all(stats[k] > limit if above else stats[k] <= limit for k, above, limit in rule):
                total += weight
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_training_sees_no_held_out_label(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality").cast("int")).otherwise(F.col("quality").cast("int")))
    assert quality.train(docs, labels) == quality.train(docs, turned)
