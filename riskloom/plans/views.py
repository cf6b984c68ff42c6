"""Monitoring views derived from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.fixed_values import ALERT_THRESHOLD
from riskloom.functions import scores, text, urls
from riskloom.operators.frames import spread_out

USER_ID = 7
OWNER_ID = 1


class Lake:
    """The tables of one folder and the views over them.  Nothing is cached but two scalars."""

    _open: dict[tuple[int, str], "Lake"] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._as_of: dt.datetime | None = None
        self._step: int | None = None

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Lake":
        key = (id(spark), folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def as_of(self) -> dt.datetime:
        """Latest event time, the fixed "now" of every rolling window."""
        if self._as_of is None:
            text_value = self.table("events").agg(F.max("ts").cast("string")).first()[0]
            self._as_of = dt.datetime.fromisoformat(text_value)
        return self._as_of

    @property
    def step(self) -> int:
        """Events per document; ties document n to event n * step."""
        if self._step is None:
            self._step = max(1, self.table("events").count() // max(1, self.table("documents").count()))
        return self._step

    def spread(self, name: str = "documents", key: str = "doc_id") -> DataFrame:
        """A table spread over the cores, for heavy per-row work."""
        return spread_out(self.table(name), key)

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def sources(self) -> DataFrame:
        names = self.table("documents").select(F.col("source").alias("source_id")).distinct()
        n = source_number(F.col("source_id"))
        return names.select(
            "source_id",
            F.concat(F.lit("Source "), "source_id").alias("name"),
            F.concat(F.lit("https://feeds.example.org/"), "source_id").alias("url"),
            source_type(n).alias("source_type"),
            (n % 5).alias("owner_id"),
            (n % 7 != 0).alias("is_active"),
            F.lit(300).cast("long").alias("check_interval"),
        )

    def source_keywords(self) -> DataFrame:
        """Watch words of each source: the first two words of the benchmark item with its number."""
        phrases = self.table("benchmark").select(
            F.col("item_id"), F.slice(text.words(F.col("text")), 1, 2).alias("keywords")
        )
        sources = self.sources().withColumn("item_id", source_number(F.col("source_id")))
        return sources.join(phrases, "item_id").select("source_id", "name", "owner_id", "keywords")

    def items(self) -> DataFrame:
        docs = self.table("documents").select(
            "doc_id", (F.col("doc_id") * self.step).alias("event_id"), F.col("source").alias("source_id"), "lang",
            F.substring("text", 1, 80).alias("title"), "text",
        )
        joined = docs.join(self.events().select("event_id", "ts", "value"), "event_id")
        kind = source_type(source_number(F.col("source_id")))
        score = scores.normalize_score(F.col("value"))
        stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        return joined.select(
            "doc_id", "source_id", "lang", "title", "text",
            kind.alias("source_type"),
            urls.feed_item_id(kind, F.col("doc_id").cast("string"), F.col("title"), stamp).alias("external_id"),
            score.alias("threat_score"),
            scores.level_of(score).alias("threat_level"),
            F.col("ts").alias("collected_at"),
        )

    def alerts(self) -> DataFrame:
        items = self.items().where(F.col("threat_score") >= ALERT_THRESHOLD)
        return items.select(
            F.col("doc_id").alias("alert_id"), "title", F.col("text").alias("description"), "threat_level", "threat_score",
            "source_id", "source_type",
            F.concat(F.lit("Source "), "source_id").alias("source_name"),
            F.concat(F.lit("https://feeds.example.org/"), "source_id", F.lit("/"), "doc_id").alias("source"),
            (source_number(F.col("source_id")) % 5).alias("owner_id"),
            (F.col("doc_id") % 3 == 0).alias("is_read"),
            (F.col("doc_id") % 7 == 0).alias("is_resolved"),
            F.col("collected_at").alias("created_at"),
        )

    def analyses(self) -> DataFrame:
        score = scores.normalize_score(F.col("value"))
        kind = (
            F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "document")
            .when(F.col("event_type") == "purchase", "url").when(F.col("event_type") == "signup", "rss").otherwise("telegram")
        )
        return self.events().select(
            F.col("event_id").alias("analysis_id"), "user_id", kind.alias("analysis_type"),
            F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
            score.alias("threat_score"), scores.level_of(score).alias("threat_level"),
            F.col("ts").alias("created_at"),
        )

    def analysis_keywords(self) -> DataFrame:
        """(analysis_id, keywords) for the analyses tied to a document."""
        return self.spread().select(
            (F.col("doc_id") * self.step).alias("analysis_id"), text.top_keywords(F.col("text")).alias("keywords")
        )

    def messages(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", "toxic")
        label = F.when(F.col("toxic") == 1, "EXTREMIST").otherwise("NON_EXTREMIST")
        return self.spread().select("doc_id", "text").join(labels, "doc_id").select("doc_id", "text", label.alias("label"))

    def message_rows(self) -> DataFrame:
        """Message tables: one row per conversation turn, blank messages removed."""
        message = text.strip(F.col("text"))
        rows = self.table("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), message.alias("message"))
        return rows.where(F.length("message") > 0)

    def model_scores(self) -> DataFrame:
        """Three column scorers per document."""
        body = F.col("text")
        w = text.words(body)
        ratio = F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))) / F.greatest(F.size(w), F.lit(1))
        return self.spread().select(
            "doc_id", "source",
            F.create_map(
                F.lit("length"), (F.col("n_chars") % 101) / 100.0,
                F.lit("variety"), scores.round_tie_up(ratio),
                F.lit("hash"), F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0,
            ).alias("model_scores"),
        )


def source_number(source_id: Column) -> Column:
    return F.substring(source_id, 4, 18).cast("long")


def source_type(n: Column) -> Column:
    return F.when(n % 4 == 0, "rss").when(n % 4 == 1, "telegram").when(n % 4 == 2, "url").otherwise("reddit")
