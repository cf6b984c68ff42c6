"""Pluggable classifiers over text columns, ensembles and roll-ups.

A scorer adds a map of label scores per text.  Column scorers stay in the JVM,
pipeline scorers run a fitted Spark ML model, and batch scorers hand Arrow
batches to a model that each Python worker loads once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed_values import CHUNK_CHARS, NO_CLASSIFIER, NO_CONTENT, TOP_KEYWORDS
from riskloom.functions.arrays import argmax_entry, let
from riskloom.functions.scores import ensemble_mean, level_of, round_tie_up, summary_text, threat_from_labels
from riskloom.functions.text import detect_language, keyword_tokens, strip, top_keywords, word_count
from riskloom.operators.ranking import position_block, row_index, top_k


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Consecutive pieces of ``size`` characters that cover the whole stripped text."""
    return F.regexp_extract_all(strip(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunked_label_means(text: Column, labels: dict[str, Callable[[Column], Column]], size: int = CHUNK_CHARS) -> Column:
    """Map label -> mean score over the chunks, 4 digits; empty map for blank text."""

    def means(parts: Column) -> Column:
        cells = []
        for name, fn in labels.items():
            total = F.aggregate(F.transform(parts, fn), F.lit(0.0), lambda a, x: a + x)
            cells += [F.lit(name), round_tie_up(total / F.size(parts))]
        return F.when(F.size(parts) > 0, F.create_map(*cells)).otherwise(F.create_map().cast("map<string,double>"))

    return let(chunks(text, size), means)


@dataclass(frozen=True)
class ColumnScorer:
    """Label scores as column expressions over one chunk of text."""

    name: str
    labels: dict[str, Callable[[Column], Column]]
    chunk_chars: int = CHUNK_CHARS

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, chunked_label_means(F.col(text), self.labels, self.chunk_chars))

    def threat(self, label_scores: Column) -> Column:
        return threat_from_labels(label_scores)


@dataclass(frozen=True)
class PipelineScorer:
    """A fitted Spark ML pipeline; the threat score is the probability of the ``high`` class."""

    name: str
    model: object
    classes: tuple[str, ...]
    text_column: str = "text"
    probability: str = "probability"
    high: str = "high"

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        before = df.columns
        scored = self.model.transform(df.withColumn(self.text_column, F.col(text)))
        p = vector_to_array(F.col(self.probability))
        cells = [x for i, c in enumerate(self.classes) for x in (F.lit(c), F.round(F.get(p, F.lit(i)), 4))]
        return scored.select(*before, F.create_map(*cells).alias(out))

    def threat(self, label_scores: Column) -> Column:
        return F.coalesce(label_scores[self.high], F.lit(0.0))


@dataclass(frozen=True)
class BatchScorer:
    """An external model: ``load()`` runs once per Python worker and returns ``texts -> list of label maps``.

    Long texts are cut into chunks first, and the chunk scores are averaged per
    label, so the whole text counts.
    """

    name: str
    load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]
    chunk_chars: int = CHUNK_CHARS

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, held = self.load, {}

        @F.pandas_udf("array<map<string,double>>")
        def predict(batch: pd.Series) -> pd.Series:
            if "model" not in held:
                held["model"] = load()
            flat = [piece for pieces in batch for piece in pieces]
            scores = iter(held["model"](flat))
            return pd.Series([[{k: float(v) for k, v in next(scores).items()} for _ in pieces] for pieces in batch])

        return df.withColumn(out, _mean_of_maps(predict(chunks(F.col(text), self.chunk_chars))))

    def threat(self, label_scores: Column) -> Column:
        return threat_from_labels(label_scores)


def _mean_of_maps(maps: Column) -> Column:
    """Per-label mean over an array of label maps; each label counts the chunks that reported it."""

    def mean(ms: Column) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(ms, F.map_keys)))

        def one(k: Column) -> Column:
            found = F.filter(F.transform(ms, lambda m: m[k]), lambda v: v.isNotNull())
            return round_tie_up(F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))

        return F.map_from_arrays(keys, F.transform(keys, one))

    return let(maps, mean)


@dataclass
class ScorerSet:
    """Scorers by model id; an unknown id means the default one, ``all`` means every one."""

    scorers: dict[str, object] = field(default_factory=dict)
    default: str = ""

    def pick(self, ids: list[str] | None) -> list:
        if not ids or ids == ["all"]:
            return list(self.scorers.values()) if ids else [self.scorers[self.default]]
        picked = {(i if i in self.scorers else self.default): None for i in ids}
        return [self.scorers[i] for i in picked]


def classify(df: DataFrame, text: str, scorers: list, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``label_scores``, ``model_scores``, ``threat_score``, ``threat_level``, ``top_label`` and ``method``.

    With several scorers the score is their mean; the level comes from the
    unrounded mean.  A scorer that returns null for a row did not run there.
    """
    out = df
    for i, s in enumerate(scorers):
        out = s.add(out, text, f"_labels_{i}")
    each = [F.when(F.col(f"_labels_{i}").isNotNull(), F.round(s.threat(F.col(f"_labels_{i}")), 4)) for i, s in enumerate(scorers)]
    cells = [x for s, e in zip(scorers, each) for x in (F.lit(s.name), e)]
    ran = F.map_filter(F.create_map(*cells), lambda _, v: v.isNotNull())
    out = out.withColumn("model_scores", ran)
    mean = ensemble_mean(F.col("model_scores"), weights)
    single = len(scorers) == 1
    labels = F.coalesce(F.col("_labels_0"), F.create_map().cast("map<string,double>")) if single else F.create_map().cast("map<string,double>")
    out = (
        out.withColumn("_mean", F.coalesce(mean, F.lit(0.0)))
        .withColumn("label_scores", labels)
        .withColumn("threat_score", round_tie_up(F.col("_mean")))
        .withColumn("threat_level", level_of(F.col("_mean")))
        .withColumn("top_label", argmax_entry(F.col("label_scores")) if single else F.lit(None).cast("string"))
        .withColumn("method", F.when(F.size("model_scores") == 0, "unavailable").otherwise("single" if single else "multi_model"))
    )
    return out.drop("_mean", *[f"_labels_{i}" for i in range(len(scorers))])


def analyze(df: DataFrame, text: str, scorers: list, k: int = TOP_KEYWORDS) -> DataFrame:
    """Full text analysis; blank texts get the empty result (score 0, level low)."""
    body = F.col(text)
    blank = F.length(strip(body)) == 0
    out = classify(df, text, scorers)
    summary = F.when(F.col("method") == "unavailable", NO_CLASSIFIER).otherwise(
        summary_text(F.col("threat_level"), F.col("threat_score"), F.col("top_label")))
    return (
        out.withColumn("threat_score", F.when(blank, 0.0).otherwise(F.col("threat_score")))
        .withColumn("threat_level", F.when(blank, "low").otherwise(F.col("threat_level")))
        .withColumn("summary", F.when(blank, NO_CONTENT).otherwise(summary))
        .withColumn("keywords", top_keywords(body, k))
        .withColumn("language", detect_language(body))
        .withColumn("word_count", word_count(body))
    )


def numbered_rows(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Message rows (document_id, pos, message) with ``row``: place among the kept messages, the header being row 1."""
    indexed = row_index(rows, ["document_id"], "pos", position_block("pos"), limit)
    return indexed.withColumn("row", F.col("row_index") + 2).drop("row_index", "key_rows")


def score_rows(rows: DataFrame, scorers: list, limit: int | None = None) -> DataFrame:
    """Row results of message tables: number, message, score, level and model scores."""
    scored = classify(numbered_rows(rows, limit), "message", scorers)
    return scored.select(
        "document_id", "row", "message", "threat_score", "threat_level", "model_scores")


def roll_up(rows: DataFrame, scorers: list) -> DataFrame:
    """One row per document: mean score, level of the unrounded mean, row and word counts, summary.

    Sums are combined before the shuffle, so a document of any size is fine.
    """
    scored = classify(rows, "message", scorers)
    out = scored.groupBy("document_id").agg(
        F.avg("threat_score").alias("_mean"), F.count("*").alias("row_count"), F.sum(word_count(F.col("message"))).alias("word_count"))
    level = level_of(F.col("_mean") + 1e-9)
    score = round_tie_up(F.col("_mean"))
    summary = F.concat(
        F.lit("Document analysis: "), F.col("row_count").cast("string"), F.lit(" rows analysed. Average threat score: "),
        F.format_string("%.4f", score), F.lit(" ("), F.upper(level), F.lit(")."))
    return out.select("document_id", score.alias("threat_score"), level.alias("threat_level"), "row_count", "word_count", summary.alias("summary"))


def model_means(rows: DataFrame, scorers: list) -> DataFrame:
    """Mean score per document and model."""
    scored = classify(rows, "message", scorers)
    long = scored.select("document_id", F.explode_outer("model_scores").alias("model", "score")).where(F.col("model").isNotNull())
    return long.groupBy("document_id", "model").agg(round_tie_up(F.avg("score")).alias("mean_score"))


def document_keywords(rows: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """Top keywords over all messages of each document, ties by first occurrence."""
    long = rows.select("document_id", "pos", F.posexplode_outer(keyword_tokens(F.col("message"))).alias("at", "keyword"))
    counted = long.where(F.col("keyword").isNotNull()).groupBy("document_id", "keyword").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    return top_k(counted, ["document_id"], [F.col("n").desc(), F.col("first")], k).select("document_id", "keyword", "n", "rank")
