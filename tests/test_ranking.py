"""Exact ranks and quantiles against brute force, with one value or key holding much of the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import ranking as r
from riskloom.operators import splits


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    hot = np.full(400, 7.0)
    return np.concatenate([hot, rng.normal(5, 3, 700).round(2), rng.integers(0, 40, 100)])


def frame(spark, values):
    return spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)], "k string, v double")


@pytest.mark.parametrize("buckets", [4, 256])
def test_quantiles(spark, skewed, buckets):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = frame(spark, skewed)
    whole = {x["prob"]: x["value"] for x in r.quantiles(df, [], "v", probs, buckets).collect()}
    assert whole == pytest.approx({p: float(np.quantile(skewed, p)) for p in probs})
    part = {(x["k"], x["prob"]): x["value"] for x in r.quantiles(df, ["k"], "v", probs, buckets).collect()}
    groups = {"a": [v for i, v in enumerate(skewed) if i % 3], "b": [v for i, v in enumerate(skewed) if i % 3 == 0]}
    assert part == pytest.approx({(k, p): float(np.quantile(g, p)) for k, g in groups.items() for p in probs})


def test_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (None,), (4.0,)], "v double")
    assert r.quantiles(df, [], "v", [0.5]).first()["value"] == 2.0


def test_cumulative(spark, skewed):
    counts = frame(spark, skewed).groupBy("v").agg(F.count("*").alias("n"))
    for row in r.cumulative(counts, [], "v", ["n"], buckets=16).collect():
        assert row["before_n"] == int((skewed < row["v"]).sum())
        assert row["total_n"] == len(skewed)


@pytest.mark.parametrize("limit", [None, 5])
def test_row_index(spark, limit):
    rows = [("hot", i * 7) for i in range(900)] + [("cold", i) for i in (9000, 3, 500)]
    df = spark.createDataFrame(rows, "k string, p long").repartition(4)
    got = {(x["k"], x["p"]): (x["row_index"], x["key_rows"]) for x in r.row_index(df, ["k"], "p", r.position_block("p", 64), limit).collect()}
    expected = {("hot", i * 7): (i, 900) for i in range(900) if limit is None or i < limit}
    expected |= {("cold", p): (i, 3) for i, p in enumerate((3, 500, 9000))}
    assert got == expected


def test_first_by_and_top_k(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("x", 2, "b"), ("y", 5, "z")], "k string, o int, v string")
    assert sorted(tuple(x) for x in r.first_by(df, ["k"], ["o"]).collect()) == [("x", 1, "a"), ("y", 5, "z")]
    top = r.top_k(df, ["k"], [F.col("o").desc()], 2).select("k", "v", "rank").collect()
    assert sorted(tuple(x) for x in top) == [("x", "b", 2), ("x", "c", 1), ("y", "z", 1)]


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(5)
    score, label = rng.integers(0, 12, 300) / 10, rng.integers(0, 2, 300)
    pos, neg = score[label == 1], score[label == 0]
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame([("high" if y else "low", float(s)) for y, s in zip(label, score)], "label string, score double")
    assert ev.roc_auc(df, "high").first()["auc"] == pytest.approx(expected)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    vectors = df.select((F.col("label") == "high").cast("double").alias("label"), array_to_vector(F.array(-F.col("score"), F.col("score"))).alias("rawPrediction"))
    assert BinaryClassificationEvaluator(numBins=0).evaluate(vectors) == pytest.approx(expected)


def test_report_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rng = np.random.default_rng(8)
    rows = [(str(a), str(b)) for a, b in zip(rng.integers(0, 3, 200), rng.integers(0, 3, 200))]
    df = spark.createDataFrame(rows, "label string, prediction string")
    ours = ev.averages(ev.class_report(df)).first()
    numeric = df.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    for name, column in {"accuracy": "accuracy", "f1": "weighted_f1", "weightedPrecision": "weighted_precision", "weightedRecall": "weighted_recall"}.items():
        assert MulticlassClassificationEvaluator(metricName=name).evaluate(numeric) == pytest.approx(ours[column])


def test_splits_are_stratified(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("label"))
    counts = {(x["label"], x["is_test"]): x["count"] for x in splits.split(df, "id").groupBy("label", "is_test").count().collect()}
    assert counts == {("a", True): 160, ("a", False): 640, ("b", True): 40, ("b", False): 160}
    per_fold = splits.folds(df, "id").groupBy("label", "fold").count().collect()
    assert {(x["label"], x["count"]) for x in per_fold} == {("a", 160), ("b", 40)}
    assert splits.class_weights(df) == {"a": 0.625, "b": 2.5}
