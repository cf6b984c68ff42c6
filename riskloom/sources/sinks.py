"""Writers: reports, analyses, item and alert stores, training summaries."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_COLUMNS = ["id", "analysis_type", "status", "threat_score", "threat_level", "model_scores", "sentiment", "language", "keywords", "created_at"]


def report_rows(analyses: DataFrame) -> DataFrame:
    """The ten report columns as text; missing values become empty."""
    empty = F.lit("")
    cells = {
        "id": F.col("id").cast("string"),
        "threat_score": F.format_string("%.4f", "threat_score"),
        "model_scores": F.to_json("model_scores"),
        "keywords": F.array_join("keywords", "; "),
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    shown = []
    for name in REPORT_COLUMNS:
        value = cells.get(name, F.col(name))
        if name == "threat_score":
            value = F.when(F.col("threat_score").isNotNull(), value)
        shown.append(F.coalesce(value.cast("string"), empty).alias(name))
    return analyses.select(*shown)


def write_report(analyses: DataFrame, path: str) -> None:
    report_rows(analyses).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_batch(df: DataFrame, store: str, batch_id: int) -> None:
    """Write one batch to its own folder; a repeated batch replaces itself, so a retry leaves no copies."""
    df.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")


def read_store(spark: SparkSession, store: str, schema, before: int | None = None) -> DataFrame:
    """All stored batches, or those before one; an absent store is empty."""
    try:
        df = spark.read.schema(schema).option("basePath", store).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        df = df.where(F.col("batch_id") < before)
    return df.drop("batch_id") if "batch_id" in df.columns else df


def write_analyses(analyses: DataFrame, path: str) -> None:
    """Analyses by creation day."""
    analyses.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def with_status(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents with the status of their newest analysis; untouched ones keep theirs.

    Outcomes are told apart by ``created_at`` where they have it; of equal
    times the status last in alphabetical order counts.
    """
    when = F.col("created_at") if "created_at" in outcomes.columns else F.lit(None).cast("timestamp")
    latest = outcomes.groupBy("document_id").agg(F.max(F.struct(when.alias("at"), "status"))["status"].alias("_new"))
    return documents.join(latest, "document_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def write_training_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A small JSON document written through Spark, so any file system Spark knows will do."""
    text = spark.createDataFrame([(json.dumps(summary, indent=2, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
