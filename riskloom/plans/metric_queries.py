"""Registered dashboard and trend queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import metrics as a
from riskloom.operators import monitor as m
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import OWNER_ID, USER_ID, Lake

_DONE = f"user_id = {USER_ID} AND status = 'completed'"
_AVG_NOW = f"coalesce((SELECT avg(threat_score) FROM analyses WHERE {_DONE} AND created_at >= {q.AS_OF} - INTERVAL 24 HOUR), 0)"
_AVG_THEN = f"coalesce((SELECT avg(threat_score) FROM analyses WHERE {_DONE} AND created_at >= {q.AS_OF} - INTERVAL 48 HOUR AND created_at < {q.AS_OF} - INTERVAL 24 HOUR), 0)"
_TREND = f"CASE WHEN (SELECT count(*) FROM analyses WHERE {_DONE} AND created_at >= {q.AS_OF} - INTERVAL 48 HOUR) > 0 THEN {q.rnd(f'({_AVG_NOW} - {_AVG_THEN})')} END"
_OPEN = f"(SELECT count(*) FROM alerts WHERE owner_id = {OWNER_ID} AND NOT is_resolved AND threat_level = '%s')"


@query("dashboard", "A1 A2 A3 P13", q.with_views("analyses alerts sources", f"""
    SELECT (SELECT count(*) FROM analyses WHERE user_id = {USER_ID}) AS total_analyses,
           (SELECT count(*) FROM analyses WHERE user_id = {USER_ID} AND created_at >= {q.AS_OF} - INTERVAL 24 HOUR) AS analyses_today,
           {q.rnd(f'coalesce((SELECT avg(threat_score) FROM analyses WHERE {_DONE}), 0)')} AS avg_threat_score,
           {_TREND} AS threat_trend_24h,
           (SELECT count(*) FROM alerts WHERE owner_id = {OWNER_ID}) AS total_alerts,
           {_OPEN % 'critical'} AS critical_alerts, {_OPEN % 'high'} AS high_alerts, {_OPEN % 'medium'} AS medium_alerts, {_OPEN % 'low'} AS low_alerts,
           (SELECT count(*) FROM sources WHERE owner_id = {OWNER_ID} AND is_active) AS active_sources"""))
def dashboard(lake: Lake):
    return a.dashboard(lake.analyses(), lake.alerts(), lake.sources(), USER_ID, OWNER_ID, lake.as_of)


@query("average_score", "A2", q.with_views("analyses", f"SELECT user_id, {q.rnd('avg(threat_score)')} AS avg_threat_score FROM analyses WHERE status = 'completed' GROUP BY user_id"))
def average_score(lake: Lake):
    done = lake.analyses().where(F.col("status") == "completed")
    return done.groupBy("user_id").agg(a.round_tie_up(F.avg("threat_score")).alias("avg_threat_score"))


@query("score_trend", "A3", q.with_views("analyses", f"SELECT {_TREND} AS threat_trend_24h"))
def score_trend(lake: Lake):
    return a.analysis_metrics(lake.analyses(), USER_ID, lake.as_of).select("threat_trend_24h")


@query("level_breakdown", "A4", q.with_views("analyses", f"SELECT threat_level, count(*) AS n FROM analyses WHERE {_DONE} AND created_at >= {q.AS_OF} - INTERVAL 24 HOUR GROUP BY 1"))
def level_breakdown(lake: Lake):
    return a.level_breakdown(lake.analyses(), USER_ID, lake.as_of)


_BREAKDOWN = f"""
    , breakdown AS (SELECT name, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT source_type AS name, count(*) AS n FROM items WHERE source_id IN (SELECT source_id FROM sources WHERE owner_id = {OWNER_ID}) GROUP BY 1
        UNION ALL SELECT CASE analysis_type WHEN 'document' THEN 'upload' ELSE 'text' END, count(*) FROM analyses
                  WHERE user_id = {USER_ID} AND analysis_type IN ('document', 'text') GROUP BY 1) GROUP BY name)
"""


def _breakdown(lake: Lake):
    return a.source_breakdown(lake.items(), lake.sources(), lake.analyses(), USER_ID, OWNER_ID)


@query("source_breakdown", "A5 J5", q.with_views("items sources analyses", _BREAKDOWN + "SELECT * FROM breakdown"))
def source_breakdown(lake: Lake):
    return _breakdown(lake)


@query("source_bars", "A10 W5", q.with_views("items sources analyses", _BREAKDOWN + """
    SELECT name, n, max(n) OVER () AS largest, CAST(floor(n * 100 / max(n) OVER () + 0.5) AS BIGINT) AS percent FROM breakdown"""))
def source_bars(lake: Lake):
    return a.bars(_breakdown(lake))


@query("source_bar_text", "A10", q.with_views("items sources analyses", _BREAKDOWN + "SELECT string_agg(n || ' ' || name, ' · ' ORDER BY n DESC, name) AS summary FROM breakdown"))
def source_bar_text(lake: Lake):
    return a.breakdown_text(_breakdown(lake))


def _points_sql(where: str) -> str:
    return f"""
    , points AS (
        SELECT {q.zone_day('i.collected_at')} AS date, i.source_id, s.name AS source_name, s.source_type, count(*) AS item_count,
               {q.rnd('avg(i.threat_score)')} AS avg_threat_score
        FROM items i JOIN sources s USING (source_id) WHERE i.collected_at >= {q.AS_OF} - INTERVAL 30 DAY {where} GROUP BY ALL)
"""


def _points(lake: Lake, owner: int | None = None):
    sources = lake.sources() if owner is None else m.owned(lake.sources(), owner)
    return a.daily_trend(lake.items(), sources, lake.as_of)


@query("source_daily_trend", "A6 J1 O2 P1", q.with_views("items sources", _points_sql("") + "SELECT * FROM points"))
def source_daily_trend(lake: Lake):
    return _points(lake).orderBy("date", "source_id")


@query("owner_daily_trend", "A6 P13", q.with_views("items sources", _points_sql(f"AND s.owner_id = {OWNER_ID}") + "SELECT * FROM points"))
def owner_daily_trend(lake: Lake):
    return _points(lake, OWNER_ID).orderBy("date", "source_id")


@query("severity_mix", "A7 W5", q.with_views("alerts", """
    SELECT l.threat_level, count(a.alert_id) AS n, coalesce(CAST(floor(count(a.alert_id) * 100 / nullif((SELECT count(*) FROM alerts WHERE NOT is_resolved), 0) + 0.5) AS BIGINT), 0) AS percent
    FROM (SELECT unnest(['critical','high','medium','low']) AS threat_level) l
    LEFT JOIN alerts a ON a.threat_level = l.threat_level AND NOT a.is_resolved GROUP BY 1"""))
def severity_mix(lake: Lake):
    return a.severity_mix(lake.alerts())


def _slot_sql(window: str, seconds: float) -> str:
    return f"""
    , w AS (SELECT least(23, CAST(floor((epoch_us(created_at) - epoch_us({q.AS_OF} - INTERVAL {window})) / 1e6 / {seconds}) AS BIGINT)) AS slot, threat_level
            FROM alerts WHERE created_at >= {q.AS_OF} - INTERVAL {window} AND created_at <= {q.AS_OF})
"""


@query("slot_histogram", "A8", q.with_views("alerts", _slot_sql("7 DAY", 7 * 86400 / 24) + """
    SELECT r.slot, count(*) FILTER (threat_level = 'critical') AS critical, count(*) FILTER (threat_level = 'high') AS high, count(*) FILTER (threat_level = 'medium') AS medium,
           count(*) FILTER (threat_level = 'low') AS low FROM (SELECT unnest(range(24)) AS slot) r LEFT JOIN w USING (slot) GROUP BY 1"""))
def slot_histogram(lake: Lake):
    return a.slot_histogram(lake.alerts(), lake.as_of, dt.timedelta(days=7))


@query("hourly_counts", "A9", q.with_views("alerts", _slot_sql("24 HOUR", 3600.0) + "SELECT r.slot, count(w.slot) AS n FROM (SELECT unnest(range(24)) AS slot) r LEFT JOIN w USING (slot) GROUP BY 1"))
def hourly_counts(lake: Lake):
    return a.hourly_counts(lake.alerts(), lake.as_of)


@query("top_keywords", "A11 W3", q.with_views("doc_keywords", "SELECT keyword, count(*) AS n FROM doc_keywords GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10"))
def top_keywords(lake: Lake):
    return a.keyword_ranking(lake.analysis_keywords(), 10)


@query("scan_results", "A31 R8", q.with_views("items sources", f"""
    SELECT s.source_id, count(i.doc_id) AS fetched, count(*) FILTER (i.collected_at >= {q.AS_OF} - INTERVAL 5 DAY) AS new
    FROM sources s LEFT JOIN items i USING (source_id) WHERE s.is_active GROUP BY 1"""))
def scan_results(lake: Lake):
    items = lake.items()
    stored = items.where(F.col("collected_at") < m.ntz(lake.as_of - dt.timedelta(days=5)))
    return a.poll_results(items, stored, lake.sources()).select("source_id", "fetched", "new")


@query("scan_summary", "A31", q.with_views("items sources", f"""
    SELECT (SELECT count(*) FROM sources WHERE is_active) AS sources_polled, count(*) AS fetched, count(*) FILTER (collected_at >= {q.AS_OF} - INTERVAL 5 DAY) AS new, CAST(0 AS BIGINT) AS failed
    FROM items WHERE source_id IN (SELECT source_id FROM sources WHERE is_active)"""))
def scan_summary(lake: Lake):
    items = lake.items()
    stored = items.where(F.col("collected_at") < m.ntz(lake.as_of - dt.timedelta(days=5)))
    return a.scan_summary(a.poll_results(items, stored, lake.sources()))


@query("trend_kpis", "A32", q.with_views("items sources", _points_sql("") + f"""
    SELECT count(DISTINCT source_id) AS series, count(DISTINCT date) AS days, {q.rnd('avg(avg_threat_score)')} AS mean_of_days,
           {q.rnd('sum(avg_threat_score * item_count) / sum(item_count)')} AS weighted_mean, max(avg_threat_score) AS peak FROM points"""))
def trend_kpis(lake: Lake):
    return a.trend_kpis(_points(lake))


@query("alert_donut", "A33", q.with_views("alerts", f"""
    SELECT {_OPEN % 'critical'} AS critical, {_OPEN % 'high'} AS high,
           greatest(0, (SELECT count(*) FROM alerts WHERE owner_id = {OWNER_ID}) - {_OPEN % 'critical'} - {_OPEN % 'high'}) AS other"""))
def alert_donut(lake: Lake):
    return a.donut(a.alert_metrics(lake.alerts(), OWNER_ID))


@query("open_counts", "A34", q.with_views("alerts sources", """
    SELECT (SELECT count(*) FROM alerts WHERE NOT is_read AND NOT is_resolved) AS unread_open, (SELECT count(*) FROM alerts WHERE NOT is_resolved) AS open,
           (SELECT coalesce(bool_and(is_active), false) FROM sources) AS all_active"""))
def open_counts(lake: Lake):
    return a.open_counts(lake.alerts(), lake.sources())


@query("urgent_in_feed", "A35", q.with_views("alerts items", """
    SELECT (SELECT count(*) FROM alerts WHERE threat_level IN ('high', 'critical')) + (
        SELECT count(*) FROM items i WHERE threat_level IN ('high', 'critical') AND NOT EXISTS (
            SELECT 1 FROM alerts a WHERE a.title = i.title AND a.source_name = 'Source ' || i.source_id)) AS urgent"""))
def urgent_in_feed(lake: Lake):
    items = lake.items().withColumn("source_name", F.concat(F.lit("Source "), "source_id"))
    return a.urgent_count(m.combined_feed(lake.alerts(), items))


@query("trend_days", "U2", q.with_views("items sources", _points_sql("") + "SELECT DISTINCT date FROM points"))
def trend_days(lake: Lake):
    return _points(lake).select("date").distinct()


@query("trend_series", "U2 J7", q.with_views("items sources", _points_sql("") + f"""
    SELECT DISTINCT p.source_id, coalesce(s.name, p.source_id) AS name FROM points p LEFT JOIN sources s ON s.source_id = p.source_id AND s.owner_id = {OWNER_ID}"""))
def trend_series(lake: Lake):
    return a.series_names(_points(lake), m.owned(lake.sources(), OWNER_ID))


@query("trend_pivot", "U3", q.with_views("items sources", _points_sql("") + "SELECT * FROM (PIVOT points ON source_id USING max(avg_threat_score) GROUP BY date)"))
def trend_pivot(lake: Lake):
    return a.trend_pivot(_points(lake))


@query("daily_volume", "A38", q.with_views("items", f"SELECT {q.zone_day('collected_at')} AS date, count(*) AS posts, {q.rnd('avg(threat_score)')} AS avg_score, max(threat_score) AS max_score FROM items GROUP BY 1"))
def daily_volume(lake: Lake):
    return a.daily_volume(lake.items())


@query("channel_statistics", "A38", q.with_views("items", f"""
    SELECT source_id, count(*) AS posts, {q.rnd('avg(threat_score)')} AS avg_score, max(threat_score) AS max_score,
           count(*) FILTER (threat_level IN ('high', 'critical')) AS urgent, min(collected_at) AS first_seen, max(collected_at) AS last_seen FROM items GROUP BY 1"""))
def channel_statistics(lake: Lake):
    return a.channel_statistics(lake.items())
