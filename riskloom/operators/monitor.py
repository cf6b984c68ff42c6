"""Operators over sources, items and alerts: projections, filters, joins, set operations, row changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed_values import ALERT_THRESHOLD, SOURCE_TYPES
from riskloom.functions.arrays import let
from riskloom.functions.scores import model_scores_or_fallback, normalize_level, normalize_score
from riskloom.functions.times import clamp, ntz
from riskloom.operators.frames import join_dimension, merge_single_rows
from riskloom.operators.ranking import first_by

# Two collected items are the same when these agree.
ITEM_KEY = ["source_id", "source_type", "external_id"]


def owned(df: DataFrame, owner, column: str = "owner_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(owner))


def newest(df: DataFrame, by: str, tie: str, limit: int) -> DataFrame:
    """Most recent rows first; the tie column makes the cut deterministic."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(limit)


def since(df: DataFrame, column: str, as_of: dt.datetime, days: int) -> DataFrame:
    """Rows of the last ``days`` days, ``days`` clamped to 1..180."""
    return df.where(F.col(column) >= ntz(as_of - dt.timedelta(days=clamp(days, 1, 180))))


def active(sources: DataFrame) -> DataFrame:
    """Sources that are polled; one without the flag is."""
    return sources.where(F.coalesce("is_active", F.lit(True)))


def with_text(items: DataFrame) -> DataFrame:
    return items.where(F.length("text") > 0)


def recent_items(items: DataFrame, sources: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 200) -> DataFrame:
    """Items of the given sources, newest first, with source attributes and display defaults."""
    fresh = since(items.where(F.col("source_type").isin(*SOURCE_TYPES)), "collected_at", as_of, days)
    named = sources.select("source_id", F.col("name").alias("source_name"), F.col("source_type").alias("_type"))
    joined = join_dimension(fresh, named, "source_id").select(
        "doc_id", "source_id", "source_name", F.col("_type").alias("source_type"),
        F.coalesce(F.when(F.length("title") > 0, F.col("title")), F.lit("(untitled)")).alias("title"),
        F.coalesce("threat_level", F.lit("low")).alias("threat_level"),
        normalize_score(F.col("threat_score")).alias("threat_score"),
        "collected_at",
    )
    return newest(joined, "collected_at", "doc_id", clamp(limit, 1, 1000))


def new_items(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched items with text, one per key, that are not stored yet."""
    once = with_text(fetched).dropDuplicates(ITEM_KEY)
    return once.join(stored.select(*ITEM_KEY), ITEM_KEY, "left_anti")


def first_sightings(items: DataFrame, order: str) -> DataFrame:
    """Earliest row per item key."""
    return first_by(items, ITEM_KEY, [order])


def is_alert(score: Column, threshold: float = ALERT_THRESHOLD) -> Column:
    return score >= threshold


def raise_alerts(items: DataFrame, sources: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Alert rows for items at or above the threshold, attributed to the source's owner."""
    owners = sources.select("source_id", F.col("name").alias("source_name"), "owner_id", F.col("url").alias("_url"))
    hot = join_dimension(items.where(is_alert(F.col("threat_score"), threshold)), owners, "source_id")
    body = F.coalesce("text", F.lit(""))
    address = F.coalesce("url", "_url") if "url" in items.columns else F.col("_url")
    return hot.select(
        F.coalesce(F.when(F.length("title") > 0, F.col("title")), F.substring(body, 1, 120)).alias("title"),
        body.alias("description"),
        "threat_level", "threat_score",
        address.alias("source"), "source_type", "owner_id", "source_id",
        F.struct("source_name", "external_id").alias("details"),
        F.lit(False).alias("is_read"), F.lit(False).alias("is_resolved"),
        F.col("collected_at").alias("created_at"),
    )


def alert_event(alerts: DataFrame) -> DataFrame:
    """(owner_id, event): each alert as the JSON message its owner receives."""
    fields = [c for c in alerts.columns if c != "owner_id"]
    body = F.struct(F.lit("alert").alias("event"), F.struct(*fields).alias("alert"))
    return alerts.select("owner_id", F.to_json(body).alias("event"))


def public_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "alert_id", "title", "description", "threat_level",
        normalize_score(F.coalesce("threat_score", F.lit(0.0))).alias("threat_score"),
        "source", "source_name", "source_type",
        F.coalesce("is_read", F.lit(False)).alias("is_read"), F.coalesce("is_resolved", F.lit(False)).alias("is_resolved"),
        "created_at",
    )


def public_analyses(analyses: DataFrame) -> DataFrame:
    """Analyses with display defaults and the model scores of old records.

    Old records keep scores in ``detail_scores`` (a map) or only name a ``detail_model``.
    """
    scores = model_scores_or_fallback(F.col("model_scores"), F.col("detail_scores"), F.col("detail_model"), F.col("threat_score"))
    return analyses.select(
        "analysis_id", F.coalesce("analysis_type", F.lit("text")).alias("analysis_type"),
        F.coalesce("status", F.lit("completed")).alias("status"), "threat_score", "threat_level", scores.alias("model_scores"), "created_at")


def public_documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        "document_id", "filename", "original_filename", "file_type", "file_size",
        F.coalesce("status", F.lit("completed")).alias("status"), "created_at")


def public_sources(sources: DataFrame) -> DataFrame:
    return sources.select(
        "source_id", "name", "url", "source_type",
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.coalesce("check_interval", F.lit(300)).alias("check_interval"),
    )


def search_alerts(alerts: DataFrame, severity: str | None = None, source_name: str | None = None, term: str | None = None) -> DataFrame:
    """Alerts matching the chosen severity, source and case-insensitive substring."""
    kept = alerts
    if severity:
        kept = kept.where(normalize_level(F.col("threat_level")) == severity)
    if source_name:
        kept = kept.where(F.col("source_name") == source_name)
    if term and term.strip():
        empty = F.lit("")
        hay = F.lower(F.concat_ws(" ", F.coalesce("title", empty), F.coalesce("description", empty), F.coalesce("source", empty)))
        kept = kept.where(hay.contains(term.strip().lower()))
    return kept


def feed_alerts(alerts: DataFrame, as_of: dt.datetime, max_age: dt.timedelta, source_name: str | None = None, level: str | None = None) -> DataFrame:
    """Alerts with a source type, not older than ``max_age`` (rows without a time stay)."""
    kept = alerts.where((F.length("source_type") > 0) & (F.col("created_at").isNull() | (F.col("created_at") >= ntz(as_of - max_age))))
    if source_name:
        kept = kept.where(F.col("source_name") == source_name)
    if level:
        kept = kept.where(F.col("threat_level") == level)
    return kept


def combined_feed(alerts: DataFrame, items: DataFrame) -> DataFrame:
    """Alerts and the items that raised none (by title and source name), newest first."""
    left = alerts.select(
        F.concat(F.lit("alert-"), F.col("alert_id").cast("string")).alias("feed_id"), F.lit("alert").alias("kind"), "title",
        F.coalesce(F.when(F.length("source_name") > 0, F.col("source_name")), "source", F.lit("Unknown source")).alias("source_name"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "threat_level", "threat_score",
        F.col("created_at").alias("at"), "is_resolved",
    )
    seen = left.select("title", "source_name").distinct()
    right = items.join(seen, ["title", "source_name"], "left_anti").select(
        F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("feed_id"), F.lit("scan").alias("kind"), "title", "source_name",
        "source_type", "threat_level", "threat_score", F.col("collected_at").alias("at"), F.lit(False).alias("is_resolved"),
    )
    return left.unionByName(right).orderBy(F.col("at").desc(), "feed_id")


def name_conflicts(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates whose owner already has a source of that name, or of that type and address."""
    by_name = candidates.join(sources.select("owner_id", "name").distinct(), ["owner_id", "name"], "left_semi").withColumn("problem", F.lit("name exists"))
    key = ["owner_id", "source_type", "url"]
    taken = sources.select("owner_id", "name")
    by_url = (candidates.join(taken, ["owner_id", "name"], "left_anti").join(sources.select(*key), key, "left_semi")
              .withColumn("problem", F.lit("source exists")))
    return by_name.unionByName(by_url)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def of_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    return join_dimension(items, sources.select("source_id"), "source_id", "left_semi")


def keyword_hits(texts: DataFrame, keywords_by_source: DataFrame) -> DataFrame:
    """The watch words of each row's own source that occur in its text, case-insensitively."""
    joined = join_dimension(texts, keywords_by_source.select("source_id", "keywords"), "source_id")
    return joined.withColumn("matches", contained_keywords(F.col("text"), F.col("keywords"))).drop("keywords")


def contained_keywords(text: Column, keywords: Column) -> Column:
    return let(F.lower(text), lambda body: F.filter(keywords, lambda k: body.contains(F.lower(k))))


def mark(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (alert_id, owner_id, action, at) updates: ``read`` and ``resolve`` set their flags."""
    wanted = updates.groupBy("alert_id", "owner_id").agg(
        F.bool_or(F.col("action") == "read").alias("_read"),
        F.bool_or(F.col("action") == "resolve").alias("_resolve"),
        F.max(F.when(F.col("action") == "resolve", F.col("at"))).alias("_at"),
    )
    joined = alerts.join(wanted, ["alert_id", "owner_id"], "left")
    old = F.col("resolved_at") if "resolved_at" in alerts.columns else F.lit(None).cast("timestamp_ntz")
    off = F.lit(False)
    return (
        joined.withColumn("is_read", F.col("is_read") | F.coalesce("_read", off))
        .withColumn("resolved_at", F.coalesce("_at", old))
        .withColumn("is_resolved", F.col("is_resolved") | F.coalesce("_resolve", off))
        .drop("_read", "_resolve", "_at")
    )


def touch(sources: DataFrame, polled: DataFrame) -> DataFrame:
    """Set ``last_checked`` of polled sources; others keep theirs."""
    old = F.col("last_checked") if "last_checked" in sources.columns else F.lit(None).cast("timestamp_ntz")
    times = polled.groupBy("source_id").agg(F.max("checked_at").alias("_checked"))
    return sources.join(times, "source_id", "left").withColumn("last_checked", F.coalesce("_checked", old)).drop("_checked")


def delete_source(sources: DataFrame, source_id: str, owner) -> DataFrame:
    return sources.where(~(F.col("source_id").eqNullSafe(F.lit(source_id)) & F.col("owner_id").eqNullSafe(F.lit(owner))))


def reset_owner(alerts: DataFrame, items: DataFrame, sources: DataFrame, owner) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining alerts, remaining items, and one row with both deletion counts."""
    mine = owned(sources, owner).select("source_id")
    kept_alerts = alerts.where(~F.col("owner_id").eqNullSafe(F.lit(owner)))
    kept_items = join_dimension(items, mine, "source_id", "left_anti")
    counts = merge_single_rows(
        owned(alerts, owner).agg(F.count("*").alias("alerts_deleted")),
        of_sources(items, mine).agg(F.count("*").alias("items_deleted")),
    )
    return kept_alerts, kept_items, counts
