"""Continuous versions of the dashboard and trend aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed_values import ZONE
from riskloom.functions.scores import normalize_score, round_tie_up
from riskloom.functions.times import in_zone, ntz

EPOCH = dt.datetime(1970, 1, 1)


def _instant(ts: Column) -> Column:
    """Watermarks need instants; the session zone is UTC, so the wall time is kept."""
    return ts.cast("timestamp")


def user_metrics(analyses: DataFrame) -> DataFrame:
    """Per user: analyses, mean score of completed ones, uploads and texts."""
    done = F.when(F.col("status") == "completed", F.col("threat_score"))
    return analyses.groupBy("user_id").agg(
        F.count("*").alias("total_analyses"), round_tie_up(F.coalesce(F.avg(done), F.lit(0.0))).alias("avg_threat_score"),
        F.count_if(F.col("analysis_type") == "document").alias("upload"), F.count_if(F.col("analysis_type") == "text").alias("text"))


def daily_trend(items: DataFrame, delay: str = "1 day", zone: str = ZONE) -> DataFrame:
    """Items and mean score per local calendar day and source.

    Days are windows over the shifted local time.  In update mode a day leaves
    the state once it ends before the watermark; rows later than ``delay`` that
    belong to such a day are dropped by the stream.
    """
    local = items.withColumn("local", _instant(in_zone(F.col("collected_at"), zone))).withWatermark("local", delay)
    out = local.groupBy(F.window("local", "1 day"), "source_id").agg(F.count("*").alias("item_count"), F.avg("threat_score").alias("_avg"))
    mean = normalize_score(round_tie_up(F.coalesce("_avg", F.lit(0.0))))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "source_id", "item_count", mean.alias("avg_threat_score"))


def hourly_parts(analyses: DataFrame, as_of: dt.datetime, delay: str = "1 hour") -> DataFrame:
    """Sums per user and hour, hours counted back from ``as_of``.

    Rolling 24-hour values are sums of 24 parts, so each row updates one piece
    of state instead of the 24 overlapping windows it belongs to.  In update mode
    closed hours leave the state, as in ``daily_trend``.
    """
    offset = (as_of - EPOCH) % dt.timedelta(hours=1)
    shift = f"{int(offset.total_seconds() * 1_000_000)} microseconds"
    done = analyses.where(F.col("status") == "completed")
    timed = done.withColumn("at", _instant(F.col("created_at"))).withWatermark("at", delay)
    out = timed.groupBy("user_id", F.window("at", "1 hour", "1 hour", shift)).agg(F.count("threat_score").alias("n"), F.sum("threat_score").alias("total"))
    return out.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "total")


def rolling_trend(parts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Mean of the last 24 hours minus the mean of the 24 hours before, per user seen in either."""
    day = dt.timedelta(hours=24)
    fresh = F.col("hour") >= ntz(as_of - day)
    recent = parts.where(F.col("hour") >= ntz(as_of - 2 * day))

    def mean(cond: Column) -> Column:
        n = F.sum(F.when(cond, F.col("n")).otherwise(0))
        return F.coalesce(F.sum(F.when(cond, F.col("total")).otherwise(0.0)) / F.nullif(n, F.lit(0)), F.lit(0.0))

    return recent.groupBy("user_id").agg(round_tie_up(mean(fresh) - mean(~fresh)).alias("threat_trend_24h"))
