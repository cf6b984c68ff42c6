"""Registered streaming jobs: each drains a landing folder that Spark writes from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scores import level_of
from riskloom.functions.times import ntz
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import Lake
from riskloom.session import shared_dir
from riskloom.streaming import collector as c
from riskloom.streaming import live
from riskloom.streaming.tiers import TieredStore

_POLLED = "source_id IN (SELECT source_id FROM sources WHERE is_active)"
ITEM_COLUMNS = ["source_id", "source_type", "external_id", "title", "text", "threat_score", "collected_at"]


def land(df: DataFrame, folder: str, files: int = 4, twice: bool = False) -> tuple[str, int]:
    """The landing folder of several files that was written, and their number; with ``twice`` everything is delivered a second time.

    The rows are computed once and written as they are partitioned, so a file, and
    the task that reads it, does not grow with the table.  Only a table of fewer
    files than asked for is dealt anew.
    """
    df.write.mode("append").parquet(folder)
    rows = df.sparkSession.read.schema(df.schema).parquet(folder)
    deliveries = 1
    if len(rows.inputFiles()) < files:
        folder, rows, deliveries = f"{folder}-spread", rows.repartition(files), 0
    for _ in range(deliveries, 1 + twice):
        rows.write.mode("append").parquet(folder)
    return folder, len(df.sparkSession.read.schema(df.schema).parquet(folder).inputFiles())


def _batch(files: int) -> int:
    """Files of a batch when a landing folder is drained in three."""
    return -(-files * 3 // 8)


def _items(lake: Lake) -> DataFrame:
    return lake.items().select(*ITEM_COLUMNS)


def _rescored(fresh: DataFrame) -> DataFrame:
    """The landed score stands in for a classifier."""
    return fresh.withColumn("threat_level", level_of(F.col("threat_score")))


def _collect(lake: Lake) -> c.Collector:
    base = shared_dir(lake.spark, "collector")
    items = _items(lake)
    landing, files = land(items, f"{base}/landing", twice=True)
    job = c.Collector(lake.spark, f"{base}/stores", lake.sources(), _rescored)
    stream = c.landed(lake.spark, landing, items.schema, files_per_batch=_batch(files))
    c.run_to_end(job.run(stream, f"{base}/checkpoint"))
    return job


@query("collected_items", "R1 R2 R3 S10", q.with_views("items sources", f"SELECT source_id, source_type, external_id, title, threat_score, threat_level FROM items WHERE {_POLLED}"))
def collected_items(lake: Lake):
    job = _collect(lake)
    return lake.spark.read.parquet(job.store("items")).select("source_id", "source_type", "external_id", "title", "threat_score", "threat_level")


@query("streamed_alerts", "R3 R4 P11 P12", q.with_views("items sources", """
    SELECT s.owner_id, i.title, i.threat_score, i.threat_level, s.name AS source_name, i.external_id FROM items i JOIN sources s USING (source_id) WHERE i.threat_score >= 0.6 AND s.is_active"""))
def streamed_alerts(lake: Lake):
    job = _collect(lake)
    alert = F.from_json("event", "event string, alert struct<title string, threat_score double, threat_level string, details struct<source_name string, external_id string>>")
    rows = lake.spark.read.parquet(job.store("alerts")).select("owner_id", alert.alias("e"))
    return rows.select("owner_id", "e.alert.title", "e.alert.threat_score", "e.alert.threat_level", "e.alert.details.source_name", "e.alert.details.external_id")


@query("poll_log", "R8 A31", q.with_views("items sources", f"SELECT source_id, count(*) * 2 AS fetched, count(*) AS new FROM items WHERE {_POLLED} GROUP BY source_id"))
def poll_log(lake: Lake):
    job = _collect(lake)
    polls = lake.spark.read.parquet(job.store("polls"))
    return polls.groupBy("source_id").agg(F.sum("fetched").alias("fetched"), F.sum("new").alias("new"))


@query("stream_dedup", "R2", q.with_views("items", "SELECT source_id, source_type, external_id, collected_at FROM items"))
def stream_dedup(lake: Lake):
    base = shared_dir(lake.spark, "dedup")
    items = _items(lake)
    landing, files = land(items, f"{base}/landing", twice=True)
    stream = c.landed(lake.spark, landing, items.schema, files_per_batch=_batch(files))
    c.run_to_end(c.to_folder(c.deduplicated(stream), f"{base}/out", f"{base}/checkpoint"))
    return lake.spark.read.parquet(f"{base}/out").select("source_id", "source_type", "external_id", "collected_at")


@query("owner_alert_routes", "R4", q.with_views("alerts", "SELECT owner_id, count(*) AS n, max(threat_score) AS top_score FROM alerts GROUP BY owner_id"))
def owner_alert_routes(lake: Lake):
    base = shared_dir(lake.spark, "routes")
    alerts = lake.alerts().select("alert_id", "owner_id", "title", "threat_score", "threat_level")
    landing, _ = land(alerts, f"{base}/landing")
    stream = c.landed(lake.spark, landing, alerts.schema)
    c.run_to_end(c.to_folder(stream, f"{base}/out", f"{base}/checkpoint", by=["owner_id"]))
    return lake.spark.read.schema(alerts.schema).parquet(f"{base}/out").groupBy("owner_id").agg(F.count("*").alias("n"), F.max("threat_score").alias("top_score"))


def land_in_order(df: DataFrame, time: str, folder: str, slices: int = 4) -> str:
    """Write a landing folder slice by slice of time; the width of a slice, in which its files may come in any order."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        df.write.mode("append").parquet(folder)
        return "0 seconds"
    width = int((high - low).total_seconds()) // slices + 1
    for n in range(slices):
        edge, stop = low + dt.timedelta(seconds=n * width), low + dt.timedelta(seconds=(n + 1) * width)
        df.where((F.col(time) >= ntz(edge)) & (F.col(time) < ntz(stop))).write.mode("append").parquet(folder)
    return f"{width} seconds"


def _live(lake: Lake, name: str, table: DataFrame, keys: list[str], time: str, build) -> DataFrame:
    """The store of an aggregation that is fed by update-mode batches."""
    base = shared_dir(lake.spark, name)
    delay = land_in_order(table, time, f"{base}/landing")
    stream = build(c.landed(lake.spark, f"{base}/landing", table.schema, files_per_batch=2), delay)
    store = TieredStore(lake.spark, f"{base}/store", keys, stream.schema)
    c.run_to_end(store.run(stream, f"{base}/checkpoint"))
    return store.read()


@query("live_metrics", "R5 A1 A2 A5", q.with_views("analyses", f"""
    SELECT user_id, count(*) AS total_analyses, {q.rnd("coalesce(avg(threat_score) FILTER (status = 'completed'), 0)")} AS avg_threat_score,
           count(*) FILTER (analysis_type = 'document') AS upload, count(*) FILTER (analysis_type = 'text') AS text FROM analyses GROUP BY user_id"""))
def live_metrics(lake: Lake):
    return _live(lake, "live-metrics", lake.analyses(), ["user_id"], "created_at", lambda s, delay: live.user_metrics(s))


@query("live_daily_trend", "R6 A6", q.with_views("items", f"""
    SELECT {q.zone_day('collected_at')} AS date, source_id, count(*) AS item_count, {q.rnd('avg(threat_score)')} AS avg_threat_score FROM items GROUP BY 1, 2"""))
def live_daily_trend(lake: Lake):
    items = lake.items().select("source_id", "collected_at", "threat_score")
    return _live(lake, "live-daily", items, ["date", "source_id"], "collected_at", live.daily_trend)


@query("live_rolling_trend", "R7 A3", q.with_views("analyses", f"""
    SELECT user_id, {q.rnd(f"coalesce(avg(threat_score) FILTER (created_at >= {q.AS_OF} - INTERVAL 24 HOUR), 0) - coalesce(avg(threat_score) FILTER (created_at < {q.AS_OF} - INTERVAL 24 HOUR), 0)")} AS threat_trend_24h
    FROM analyses WHERE status = 'completed' AND created_at >= {q.AS_OF} - INTERVAL 48 HOUR GROUP BY user_id"""))
def live_rolling_trend(lake: Lake):
    as_of = lake.as_of
    parts = _live(lake, "live-rolling", lake.analyses(), ["user_id", "hour"], "created_at", lambda s, delay: live.hourly_parts(s, as_of, delay))
    return live.rolling_trend(parts, as_of)
