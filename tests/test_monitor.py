"""Monitoring operators on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics as a
from riskloom.operators import monitor as m

NOW = dt.datetime(2024, 3, 10, 12, 0, 0)
ANALYSES = "analysis_id long, user_id long, analysis_type string, status string, threat_score double, threat_level string, created_at timestamp_ntz"
ALERTS = "alert_id long, owner_id long, title string, description string, threat_level string, threat_score double, source string, source_name string, source_type string, is_read boolean, is_resolved boolean, created_at timestamp_ntz"
SOURCES = "source_id string, name string, url string, source_type string, owner_id long, is_active boolean, check_interval int"


def analysis(i, hours, score, status="completed", level="low", kind="text"):
    return (i, 1, kind, status, score, level, NOW - dt.timedelta(hours=hours))


def alert(i, owner=1, level="high", title="t", name="S", resolved=False, read=False, hours=1.0, kind="rss"):
    return (i, owner, title, "body", level, 0.7, "http://x", name, kind, read, resolved, NOW - dt.timedelta(hours=hours))


def metrics(spark, rows):
    return a.analysis_metrics(spark.createDataFrame(rows, ANALYSES), 1, NOW).first()


def test_no_rows_give_zero_and_no_trend(spark):
    row = metrics(spark, [])
    assert (row["total_analyses"], row["avg_threat_score"], row["threat_trend_24h"]) == (0, 0.0, None)


def test_trend_uses_zero_for_an_empty_side(spark):
    assert metrics(spark, [analysis(1, 30, 0.4)])["threat_trend_24h"] == -0.4
    assert metrics(spark, [analysis(1, 3, 0.4)])["threat_trend_24h"] == 0.4
    assert metrics(spark, [analysis(1, 60, 0.4)])["threat_trend_24h"] is None


def test_day_border_belongs_to_today(spark):
    row = metrics(spark, [analysis(1, 24, 0.2), analysis(2, 48, 0.6), analysis(3, 1, 0.9, status="failed")])
    assert row["analyses_today"] == 2
    assert row["threat_trend_24h"] == pytest.approx(-0.4)
    assert row["avg_threat_score"] == 0.4


def test_level_breakdown_names_missing_levels(spark):
    df = spark.createDataFrame([analysis(1, 1, 0.2, level=None), analysis(2, 2, 0.2, level="HIGH")], ANALYSES)
    assert {r["threat_level"]: r["n"] for r in a.level_breakdown(df, 1, NOW).collect()} == {"unknown": 1, "high": 1}


def test_counters_split_resolved(spark):
    df = spark.createDataFrame([alert(1), alert(2, resolved=True), alert(3, level="critical"), alert(4, owner=2)], ALERTS)
    row = a.alert_metrics(df, 1).first()
    assert (row["total_alerts"], row["high_alerts"], row["critical_alerts"], row["low_alerts"]) == (3, 1, 1, 0)
    assert a.donut(a.alert_metrics(df, 1)).first().asDict() == {"critical": 1, "high": 1, "other": 1}


def test_severity_mix_always_has_four_levels(spark):
    df = spark.createDataFrame([alert(1), alert(2, level="odd"), alert(3, level="HIGH")], ALERTS)
    assert {r["threat_level"]: (r["n"], r["percent"]) for r in a.severity_mix(df).collect()} == {
        "critical": (0, 0), "high": (2, 67), "medium": (0, 0), "low": (1, 33)}
    assert {r["n"] for r in a.severity_mix(df.limit(0)).collect()} == {0}


def test_slots_include_both_ends(spark):
    df = spark.createDataFrame([alert(1, hours=24), alert(2, hours=0), alert(3, hours=25), alert(4, hours=0.5)], ALERTS)
    slots = {r["slot"]: r["n"] for r in a.hourly_counts(df, NOW).collect()}
    assert len(slots) == 24 and slots[0] == 1 and slots[23] == 2 and sum(slots.values()) == 3
    tiny = a.slot_histogram(df, NOW, dt.timedelta(minutes=40)).collect()  # slots stay at least an hour / 24 wide
    assert sum(r["high"] for r in tiny) == 2


def test_new_items_once_and_not_stored(spark):
    schema = "source_id string, source_type string, external_id string, text string"
    fetched = spark.createDataFrame([("s", "rss", "1", "a"), ("s", "rss", "1", "a"), ("s", "rss", "2", ""), ("s", "url", "1", "b"), ("s", "rss", "3", None), ("t", "rss", "1", "c")], schema)
    stored = spark.createDataFrame([("t", "rss", "1", "old")], schema)
    got = m.new_items(fetched, stored).select(*m.ITEM_KEY).collect()
    assert sorted(tuple(r) for r in got) == [("s", "rss", "1"), ("s", "url", "1")]


def test_alert_title_falls_back_to_text(spark):
    items = spark.createDataFrame([("s", "rss", "1", "", "x" * 1500, 0.6, "high", NOW), ("s", "rss", "2", "t", "y", 0.5999, "medium", NOW)],
                                  "source_id string, source_type string, external_id string, title string, text string, threat_score double, threat_level string, collected_at timestamp_ntz")
    sources = spark.createDataFrame([("s", "Name", "http://s", "rss", 4, True, 300)], SOURCES)
    rows = m.raise_alerts(items, sources).collect()
    assert len(rows) == 1
    assert rows[0]["title"] == "x" * 120 and rows[0]["description"] == "x" * 1500 and rows[0]["owner_id"] == 4
    event = m.alert_event(m.raise_alerts(items, sources)).first()
    assert event["owner_id"] == 4 and '"event":"alert"' in event["event"]


def test_search_is_case_insensitive_and_combined(spark):
    df = spark.createDataFrame([alert(1, title="Big NEWS"), alert(2, title="news", name="T"), alert(3, title="other"), alert(4, title="news", level="low")], ALERTS)
    ids = lambda out: sorted(r["alert_id"] for r in out.collect())
    assert ids(m.search_alerts(df, "high", "S", " News ")) == [1]
    assert ids(m.search_alerts(df, term="BODY http")) == [1, 2, 3, 4]
    assert ids(m.search_alerts(df)) == [1, 2, 3, 4]


def test_feed_drops_items_that_raised_alerts(spark):
    alerts = spark.createDataFrame([alert(1, title="same"), alert(2, title="typeless", kind=None)], ALERTS)
    items = spark.createDataFrame([(1, "same", "S", "rss", "high", 0.7, NOW), (2, "same", "T", "rss", "low", 0.1, NOW), (3, "own", "S", "rss", "low", 0.1, NOW)],
                                  "doc_id long, title string, source_name string, source_type string, threat_level string, threat_score double, collected_at timestamp_ntz")
    feed = m.combined_feed(m.feed_alerts(alerts, NOW, dt.timedelta(days=1)), items).collect()
    assert sorted(r["feed_id"] for r in feed) == ["alert-1", "item-2", "item-3"]
    assert a.urgent_count(m.combined_feed(alerts, items)).first()["urgent"] == 2


def test_mark_touch_delete_reset(spark):
    alerts = spark.createDataFrame([alert(1), alert(2), alert(3, owner=2)], ALERTS)
    updates = spark.createDataFrame([(1, 1, "read", NOW), (1, 1, "resolve", NOW), (3, 1, "read", NOW)], "alert_id long, owner_id long, action string, at timestamp_ntz")
    rows = {r["alert_id"]: (r["is_read"], r["is_resolved"], r["resolved_at"]) for r in m.mark(alerts, updates).collect()}
    assert rows == {1: (True, True, NOW), 2: (False, False, None), 3: (False, False, None)}  # a foreign alert stays as it is
    sources = spark.createDataFrame([("s", "S", "u", "rss", 1, True, 300), ("t", "T", "u", "rss", 2, True, 300)], SOURCES)
    polled = spark.createDataFrame([("s", NOW), ("s", NOW - dt.timedelta(days=1))], "source_id string, checked_at timestamp_ntz")
    assert {r["source_id"]: r["last_checked"] for r in m.touch(sources, polled).collect()} == {"s": NOW, "t": None}
    assert [r["source_id"] for r in m.delete_source(sources, "s", 2).collect()] == ["s", "t"]
    assert [r["source_id"] for r in m.delete_source(sources, "s", 1).collect()] == ["t"]
    items = spark.createDataFrame([("s",), ("s",), ("t",)], "source_id string")
    left_alerts, left_items, counts = m.reset_owner(alerts, items, sources, 1)
    assert (left_alerts.count(), left_items.count()) == (1, 1)
    assert counts.first().asDict() == {"alerts_deleted": 2, "items_deleted": 2}


def test_name_conflicts(spark):
    sources = spark.createDataFrame([("s", "S", "u", "rss", 1, True, 300)], SOURCES)
    cand = spark.createDataFrame([("1", "S", "v", "rss", 1), ("2", "N", "u", "rss", 1), ("3", "S", "u", "rss", 2), ("4", "N", "u", "url", 1)],
                                 "source_id string, name string, url string, source_type string, owner_id long")
    got = {r["source_id"]: r["problem"] for r in m.name_conflicts(cand, sources).collect()}
    assert got == {"1": "name exists", "2": "source exists"}


def test_lookback_and_limit_are_clamped(spark):
    rows = [(i, "s", "rss", "t", "x", "low", 0.1, NOW - dt.timedelta(days=d)) for i, d in enumerate((0.5, 2, 200))]
    items = spark.createDataFrame(rows, "doc_id long, source_id string, source_type string, title string, text string, threat_level string, threat_score double, collected_at timestamp_ntz")
    sources = spark.createDataFrame([("s", "S", "u", "rss", 1, True, 300)], SOURCES)
    assert m.recent_items(items, sources, NOW, days=0).count() == 1
    assert m.recent_items(items, sources, NOW, days=999).count() == 2
    assert m.recent_items(items, sources, NOW, days=180, limit=0).count() == 1


def test_keyword_hits_per_source(spark):
    texts = spark.createDataFrame([(1, "s", "A big Storm"), (2, "t", "a big storm")], "doc_id long, source_id string, text string")
    words = spark.createDataFrame([("s", ["STORM", "big s", "x"]), ("t", ["rain"])], "source_id string, keywords array<string>")
    assert {r["doc_id"]: r["matches"] for r in m.keyword_hits(texts, words).collect()} == {1: ["STORM", "big s"], 2: []}


def test_breakdown_text_and_empty(spark):
    df = spark.createDataFrame([("rss", 5), ("upload", 9)], "name string, n long")
    assert a.breakdown_text(df).first()[0] == "9 upload · 5 rss"
    assert a.breakdown_text(df.limit(0)).first()[0] == "—"
    assert {r["name"]: r["percent"] for r in a.bars(df).collect()} == {"rss": 56, "upload": 100}


def test_all_active_needs_sources(spark):
    sources = spark.createDataFrame([], SOURCES)
    alerts = spark.createDataFrame([alert(1), alert(2, read=True)], ALERTS)
    assert a.open_counts(alerts, sources).first().asDict() == {"unread_open": 1, "open": 2, "all_active": False}


def test_daily_trend_crosses_the_zone_midnight(spark, lake):
    rows = [("s", "rss", 0.2, dt.datetime(2024, 3, 9, 12, 59)), ("s", "rss", 0.4, dt.datetime(2024, 3, 9, 13, 0))]
    items = spark.createDataFrame(rows, "source_id string, source_type string, threat_score double, collected_at timestamp_ntz")
    sources = spark.createDataFrame([("s", "S", "u", "rss", 1, True, 300)], SOURCES)
    got = {r["date"]: r["avg_threat_score"] for r in a.daily_trend(items, sources, NOW).collect()}
    assert got == {"2024-03-09": 0.2, "2024-03-10": 0.4}
