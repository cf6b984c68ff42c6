"""Dashboard aggregates.  Every one is a single conditional pass over its input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.fixed_values import LEVELS, SOURCE_TYPES, ZONE
from riskloom.functions.scores import normalize_level, normalize_score, round_tie_up
from riskloom.functions.text import strip
from riskloom.functions.times import ntz, zone_day
from riskloom.operators.frames import explode_once, merge_single_rows
from riskloom.operators.monitor import active, new_items, owned, since

DAY = dt.timedelta(hours=24)


def analysis_metrics(analyses: DataFrame, user, as_of: dt.datetime) -> DataFrame:
    """Total, last-24-h count, mean score of completed analyses and its 24 h trend."""
    yesterday, before = ntz(as_of - DAY), ntz(as_of - 2 * DAY)
    done = F.col("status") == "completed"
    fresh = F.col("created_at") >= yesterday
    earlier = (F.col("created_at") >= before) & ~fresh
    row = owned(analyses, user, "user_id").agg(
        F.count("*").alias("total_analyses"),
        F.count_if(fresh).alias("analyses_today"),
        F.avg(F.when(done, F.col("threat_score"))).alias("_all"),
        F.avg(F.when(done & fresh, F.col("threat_score"))).alias("_now"),
        F.avg(F.when(done & earlier, F.col("threat_score"))).alias("_then"),
        F.count_if(done & (fresh | earlier)).alias("_any"),
    )
    zero = F.lit(0.0)
    trend = round_tie_up(F.coalesce("_now", zero) - F.coalesce("_then", zero))
    return row.select(
        "total_analyses", "analyses_today",
        round_tie_up(F.coalesce("_all", zero)).alias("avg_threat_score"),
        F.when(F.col("_any") > 0, trend).alias("threat_trend_24h"),
    )


def alert_metrics(alerts: DataFrame, owner) -> DataFrame:
    """All alerts, and the unresolved ones per level."""
    open_alert = ~F.coalesce("is_resolved", F.lit(False))
    per_level = [F.count_if(open_alert & (F.col("threat_level") == lvl)).alias(f"{lvl}_alerts") for lvl in LEVELS]
    return owned(alerts, owner).agg(F.count("*").alias("total_alerts"), *per_level)


def source_metrics(sources: DataFrame, owner) -> DataFrame:
    return owned(sources, owner).agg(F.count_if("is_active").alias("active_sources"))


def dashboard(analyses: DataFrame, alerts: DataFrame, sources: DataFrame, user, owner, as_of: dt.datetime) -> DataFrame:
    """All scalar dashboard numbers in one row."""
    return merge_single_rows(analysis_metrics(analyses, user, as_of), alert_metrics(alerts, owner), source_metrics(sources, owner))


def level_breakdown(analyses: DataFrame, user, as_of: dt.datetime) -> DataFrame:
    """Completed analyses of the last 24 hours per level."""
    mine = owned(analyses, user, "user_id").where((F.col("status") == "completed") & (F.col("created_at") >= ntz(as_of - DAY)))
    level = F.lower(F.coalesce(F.when(F.length("threat_level") > 0, F.col("threat_level")), F.lit("unknown")))
    return mine.groupBy(level.alias("threat_level")).agg(F.count("*").alias("n"))


def source_breakdown(items: DataFrame, sources: DataFrame, analyses: DataFrame, user, owner) -> DataFrame:
    """Items per source type plus uploads and texts, added up by name."""
    per_source = items.groupBy("source_id", "source_type").agg(F.count("*").alias("n"))
    mine = per_source.join(owned(sources, owner).select("source_id"), "source_id", "left_semi")
    kind = F.coalesce(F.when(F.length("source_type") > 0, F.col("source_type")), F.lit("unknown"))
    scanned = mine.select(kind.alias("name"), "n")
    uploads = (
        owned(analyses, user, "user_id").where(F.col("analysis_type").isin("document", "text"))
        .groupBy("analysis_type").agg(F.count("*").alias("n"))
        .select(F.when(F.col("analysis_type") == "document", "upload").otherwise("text").alias("name"), "n")
    )
    return scanned.unionByName(uploads).groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def bars(breakdown: DataFrame) -> DataFrame:
    """Counts with their share of the largest one, in percent."""
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    return breakdown.withColumn("largest", largest).withColumn("percent", F.floor(F.col("n") * 100 / F.col("largest") + 0.5))


def breakdown_text(breakdown: DataFrame) -> DataFrame:
    """One line ``N name · …``, largest first.  There is one entry per source kind, so the list is short."""
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "name")))
    line = F.array_join(F.transform(entries, lambda e: F.concat((-e["neg"]).cast("string"), F.lit(" "), e["name"])), " · ")
    return breakdown.agg(F.coalesce(F.when(F.length(line) > 0, line), F.lit("—")).alias("summary"))


def daily_trend(items: DataFrame, sources: DataFrame, as_of: dt.datetime, days: int = 30, zone: str = ZONE) -> DataFrame:
    """Items and mean score per local day and source.  Rows are aggregated before they meet the source table."""
    fresh = since(items.where(F.col("source_type").isin(*SOURCE_TYPES)), "collected_at", as_of, days)
    points = fresh.groupBy(zone_day(F.col("collected_at"), zone).alias("date"), "source_id").agg(
        F.count("*").alias("item_count"), F.avg("threat_score").alias("_avg"))
    named = sources.select("source_id", F.col("name").alias("source_name"), "source_type")
    mean = round_tie_up(F.coalesce("_avg", F.lit(0.0)))
    return points.join(named, "source_id").select(
        "date", "source_id", "source_name", "source_type", "item_count", normalize_score(mean).alias("avg_threat_score"))


def severity_mix(alerts: DataFrame) -> DataFrame:
    """Open alerts per level, all four levels present, with the rounded percentage."""
    lvl = normalize_level(F.col("threat_level"))
    row = alerts.where(~F.coalesce("is_resolved", F.lit(False))).agg(
        F.count("*").alias("_total"), *[F.count_if(lvl == name).alias(name) for name in LEVELS])
    long = row.unpivot(["_total"], list(LEVELS), "threat_level", "n")
    share = F.floor(F.col("n") * 100 / F.nullif(F.col("_total"), F.lit(0)) + 0.5)
    return long.select("threat_level", "n", F.coalesce(share, F.lit(0)).alias("percent"))


def _slots(df: DataFrame, column: str, as_of: dt.datetime, window: dt.timedelta, slots: int) -> DataFrame:
    """Rows of the window with their slot number; the last slot includes its end."""
    seconds = max(window, dt.timedelta(hours=1)).total_seconds() / slots
    start = as_of - window
    elapsed = F.timestamp_diff("MICROSECOND", ntz(start), F.col(column)) / F.lit(1e6)
    kept = df.where((F.col(column) >= ntz(start)) & (F.col(column) <= ntz(as_of)))
    return kept.withColumn("slot", F.least(F.lit(slots - 1), F.floor(elapsed / F.lit(seconds))).cast("long"))


def _all_slots(counts: DataFrame, slots: int) -> DataFrame:
    empty = counts.sparkSession.range(slots).select(F.col("id").alias("slot"))
    return empty.join(counts, "slot", "left").na.fill(0)


def slot_histogram(alerts: DataFrame, as_of: dt.datetime, window: dt.timedelta, slots: int = 24) -> DataFrame:
    """Alerts per time slot and level."""
    lvl = normalize_level(F.col("threat_level"))
    per_slot = _slots(alerts, "created_at", as_of, window, slots).groupBy("slot").agg(
        *[F.count_if(lvl == name).alias(name) for name in LEVELS])
    return _all_slots(per_slot, slots)


def hourly_counts(rows: DataFrame, as_of: dt.datetime, column: str = "created_at") -> DataFrame:
    per_slot = _slots(rows, column, as_of, DAY, 24).groupBy("slot").agg(F.count("*").alias("n"))
    return _all_slots(per_slot, 24)


def keyword_ranking(keywords: DataFrame, k: int = 10, column: str = "keywords") -> DataFrame:
    """Most frequent keywords over the lists of all rows, trimmed and lower-cased."""
    raw = explode_once(keywords, [], F.col(column), "raw")
    each = raw.select(F.lower(strip(F.col("raw"))).alias("keyword"))
    counted = each.where(F.length("keyword") > 0).groupBy("keyword").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "keyword").limit(k)


def scan_summary(results: DataFrame) -> DataFrame:
    """Totals of a poll over per-source (source_id, fetched, new, error) rows."""
    return results.agg(
        F.count("*").alias("sources_polled"),
        F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum("new"), F.lit(0)).alias("new"),
        F.count_if(F.length("error") > 0).alias("failed"),
    )


def poll_results(fetched: DataFrame, stored: DataFrame, sources: DataFrame) -> DataFrame:
    """Per active source: rows fetched, rows that were new, and the error if its input was unreadable."""
    counts = fetched.groupBy("source_id").agg(F.count("*").alias("fetched"))
    fresh = new_items(fetched, stored).groupBy("source_id").agg(F.count("*").alias("new"))
    joined = active(sources).select("source_id").join(counts, "source_id", "left").join(fresh, "source_id", "left")
    return joined.na.fill(0, ["fetched", "new"]).withColumn("error", F.lit(None).cast("string"))


def trend_kpis(points: DataFrame) -> DataFrame:
    """Series, days, mean of the daily means, item-weighted mean and peak."""
    weighted = F.sum(F.col("avg_threat_score") * F.col("item_count")) / F.nullif(F.sum("item_count"), F.lit(0))
    zero = F.lit(0.0)
    return points.agg(
        F.count_distinct("source_id").alias("series"), F.count_distinct("date").alias("days"),
        round_tie_up(F.coalesce(F.avg("avg_threat_score"), zero)).alias("mean_of_days"),
        round_tie_up(F.coalesce(weighted, zero)).alias("weighted_mean"),
        F.coalesce(F.max("avg_threat_score"), zero).alias("peak"),
    )


MAX_SERIES = 10_000


def series_ids(points: DataFrame, most: int = MAX_SERIES) -> list[str]:
    """All series of the points in order; more than ``most`` cannot be columns and are an error, never cut."""
    ids = [row[0] for row in points.select("source_id").distinct().orderBy("source_id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} series: keep the points in rows, or choose the series to pivot")
    return ids


def trend_pivot(points: DataFrame, source_ids: list[str] | None = None) -> DataFrame:
    """One row per day, one column per source (all of them, or the chosen ones), null where a source has no point."""
    return points.groupBy("date").pivot("source_id", series_ids(points) if source_ids is None else source_ids).agg(F.max("avg_threat_score"))


def series_names(points: DataFrame, sources: DataFrame) -> DataFrame:
    ids = points.select("source_id").distinct()
    return ids.join(sources.select("source_id", "name"), "source_id", "left").withColumn("name", F.coalesce("name", "source_id"))


def donut(alert_row: DataFrame) -> DataFrame:
    rest = F.col("total_alerts") - F.col("critical_alerts") - F.col("high_alerts")
    return alert_row.select(F.col("critical_alerts").alias("critical"), F.col("high_alerts").alias("high"), F.greatest(F.lit(0), rest).alias("other"))


def open_counts(alerts: DataFrame, sources: DataFrame) -> DataFrame:
    """Unread open alerts, open alerts, and whether there are sources and all are active."""
    left = alerts.agg(
        F.count_if(~F.coalesce("is_read", F.lit(False)) & ~F.coalesce("is_resolved", F.lit(False))).alias("unread_open"),
        F.count_if(~F.coalesce("is_resolved", F.lit(False))).alias("open"))
    right = sources.agg(F.coalesce(F.every("is_active"), F.lit(False)).alias("all_active"))
    return merge_single_rows(left, right)


def urgent_count(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count_if(F.col("threat_level").isin("high", "critical")).alias("urgent"))


def daily_volume(items: DataFrame, zone: str = ZONE) -> DataFrame:
    return items.groupBy(zone_day(F.col("collected_at"), zone).alias("date")).agg(
        F.count("*").alias("posts"), round_tie_up(F.avg("threat_score")).alias("avg_score"), F.max("threat_score").alias("max_score"))


def channel_statistics(items: DataFrame) -> DataFrame:
    return items.groupBy("source_id").agg(
        F.count("*").alias("posts"), round_tie_up(F.avg("threat_score")).alias("avg_score"), F.max("threat_score").alias("max_score"),
        F.count_if(F.col("threat_level").isin("high", "critical")).alias("urgent"),
        F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen"))
