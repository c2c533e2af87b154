"""The cascade over class means reaches the recall and precision that its thresholds are chosen for."""

import os

import pytest
from pyspark.sql import functions as F

from quern.queries import shop
from quern.tables import table

DATA = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_recall_and_precision_reach_the_target(spark):
    vectors = table(spark, DATA, "embeddings").select("vec_id", "label", "embedding")
    kept = shop.cascade_to_targets(vectors).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("class")).cast("int")).alias("t")).first()
    total = vectors.filter("label IS NOT NULL").count()
    print("recall", kept["t"], total, "kept", kept["n"])
    assert kept["t"] >= shop.RECALL * total and kept["t"] >= shop.PRECISION * kept["n"]


def test_a_sample_without_true_pairs_asks_the_oracle_of_all(spark, monkeypatch):
    monkeypatch.setattr(shop, "SAMPLE_ROWS", 0)
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 0.9])], "vec_id long, label int, embedding array<float>")
    assert sorted((r["vec_id"], r["class"], r["decided_by"]) for r in shop.cascade_to_targets(v).collect()) == [(1, 0, "oracle"), (2, 1, "oracle"), (3, 1, "oracle")]
