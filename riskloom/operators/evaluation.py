"""Classifier metrics from (label, prediction, score) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scores import round_tie_up
from riskloom.operators.ranking import cumulative


def confusion(predictions: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per actual label, one column per predicted label, in the given order."""
    cells = [F.count_if(F.col("prediction") == name).alias(f"predicted_{name}") for name in labels]
    return predictions.groupBy(*(keys or []), "label").agg(*cells)


def class_report(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class and key (a model or fold)."""
    keys = keys or []
    pairs = predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))
    as_label = pairs.select(*keys, F.col("label").alias("name"), "n", F.lit(0).alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    as_said = pairs.select(*keys, F.col("prediction").alias("name"), F.lit(0).alias("n"), F.col("n").alias("said"), F.lit(0).alias("hit"))
    per = as_label.unionByName(as_said).groupBy(*keys, "name").agg(
        F.sum("n").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hit") / F.nullif("said", F.lit(0)), zero)
    recall = F.coalesce(F.col("hit") / F.nullif("support", F.lit(0)), zero)
    scored = per.select(*keys, "name", "support", "hit", precision.alias("precision"), recall.alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(F.col("precision") * F.col("recall") * 2 / F.nullif(both, F.lit(0.0)), zero)
    return scored.withColumn("f1", f1)


def averages(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted averages."""
    keys = keys or []
    total = F.sum("support")
    cells = [(F.sum("hit") / total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        cells.append(F.avg(m).alias(f"macro_{m}"))
        cells.append((F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}"))
    return report.groupBy(*keys).agg(*cells, total.alias("support"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All floating-point columns rounded."""
    types = dict(df.dtypes)
    return df.select(*[round_tie_up(F.col(c), digits).alias(c) if types[c] == "double" else F.col(c) for c in df.columns])


def roc_auc(predictions: DataFrame, positive: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, ties count half.

    Scores are counted first; negatives below each distinct score come from a
    bucketed prefix sum, so no pair is formed and no task sees all rows.
    """
    keys = keys or []
    hit = F.col("label") == positive
    counts = predictions.groupBy(*keys, "score").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    ranked = cumulative(counts, keys, "score", ["pos", "neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ranked.groupBy(*keys).agg((won / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def fold_summary(fold_metrics: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    cells = [c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return fold_metrics.groupBy(*keys).agg(*cells)


def best(summary: DataFrame, name: str, metric: str) -> DataFrame:
    return summary.orderBy(F.col(metric).desc(), name).limit(1)
