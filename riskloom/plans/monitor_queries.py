"""Registered queries over sources, items and alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions.scores import level_of
from riskloom.operators import monitor as m
from riskloom.operators.frames import join_dimension
from riskloom.operators.ranking import first_by
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import OWNER_ID, USER_ID, Lake

_ALERT_COLS = "alert_id, title, description, threat_level, threat_score, source, source_name, source_type, is_read, is_resolved, created_at"


@query("public_alerts", "P6 P13 O1", q.with_views("alerts", f"SELECT {_ALERT_COLS} FROM alerts WHERE owner_id = {OWNER_ID} ORDER BY created_at DESC, alert_id LIMIT 100"))
def public_alerts(lake: Lake):
    return m.newest(m.public_alerts(m.owned(lake.alerts(), OWNER_ID)), "created_at", "alert_id", 100)


@query("public_sources", "P6 P13 O1", q.with_views("sources", f"SELECT source_id, name, url, source_type, is_active, check_interval FROM sources WHERE owner_id = {OWNER_ID}"))
def public_sources(lake: Lake):
    return m.public_sources(m.owned(lake.sources(), OWNER_ID))


@query("analysis_history", "P13 O1 O3", q.with_views("analyses", f"SELECT * FROM analyses WHERE user_id = {USER_ID} ORDER BY created_at DESC, analysis_id LIMIT 50"))
def analysis_history(lake: Lake):
    return m.newest(m.owned(lake.analyses(), USER_ID, "user_id"), "created_at", "analysis_id", 50)


@query("analysis_lookup", "O4 P13", q.with_views("analyses", f"SELECT * FROM analyses WHERE user_id = {USER_ID} AND analysis_id = (SELECT min(event_id) FROM events WHERE user_id = {USER_ID})"))
def analysis_lookup(lake: Lake):
    mine = m.owned(lake.analyses(), USER_ID, "user_id")
    first = m.owned(lake.events(), USER_ID, "user_id").agg(F.min("event_id").alias("analysis_id"))
    return mine.join(first, "analysis_id", "left_semi")


@query("public_analyses", "P6 P7", q.with_views("analyses", """
    SELECT analysis_id, CASE WHEN analysis_type = 'rss' THEN 'text' ELSE analysis_type END AS analysis_type, CASE WHEN status = 'failed' THEN 'completed' ELSE status END AS status,
           threat_score, threat_level, CASE WHEN analysis_type = 'document' THEN 'old=' WHEN analysis_type = 'url' THEN 'named=' ELSE 'main=' END || printf('%.4f', threat_score) AS model_scores, created_at
    FROM analyses"""))
def public_analyses(lake: Lake):
    kind, score = F.col("analysis_type"), F.col("threat_score").cast("string")
    raw = lake.analyses().select(
        "analysis_id", F.when(kind != "rss", kind).alias("analysis_type"), F.when(F.col("status") != "failed", F.col("status")).alias("status"),
        "threat_score", "threat_level", "created_at",
        F.when(~kind.isin("document", "url"), F.create_map(F.lit("main"), score)).alias("model_scores"),
        F.when(kind == "document", F.create_map(F.lit("old"), score)).alias("detail_scores"),
        F.when(kind == "url", "named").alias("detail_model"))
    shown = m.public_analyses(raw)
    cells = F.transform(F.map_entries("model_scores"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return shown.withColumn("model_scores", F.array_join(cells, ","))


@query("public_documents", "P6", """
    SELECT doc_id AS document_id, doc_id || '.csv' AS filename, source || '.csv' AS original_filename, 'csv' AS file_type, n_chars AS file_size,
           CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM documents""")
def public_documents(lake: Lake):
    docs = lake.table("documents").select(
        F.col("doc_id").alias("document_id"), F.concat("doc_id", F.lit(".csv")).alias("filename"), F.concat("source", F.lit(".csv")).alias("original_filename"),
        F.lit("csv").alias("file_type"), F.col("n_chars").alias("file_size"), F.when(F.col("doc_id") % 2 == 1, "pending").alias("status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    return m.public_documents(docs)


_SEARCH_TERM = "the"


@query("alert_search", "P8", q.with_views("alerts", f"""
    SELECT {_ALERT_COLS} FROM alerts
    WHERE threat_level = 'high' AND source_name = 'Source src1'
      AND contains(lower(title || ' ' || description || ' ' || source), '{_SEARCH_TERM}')"""))
def alert_search(lake: Lake):
    return m.public_alerts(m.search_alerts(lake.alerts(), "high", "Source src1", _SEARCH_TERM))


@query("alert_stream_page", "P8 O3", q.with_views("alerts", f"""
    SELECT {_ALERT_COLS} FROM alerts WHERE contains(lower(title || ' ' || description || ' ' || source), '{_SEARCH_TERM}')
    ORDER BY created_at DESC, alert_id LIMIT 8"""))
def alert_stream_page(lake: Lake):
    return m.newest(m.public_alerts(m.search_alerts(lake.alerts(), term=_SEARCH_TERM)), "created_at", "alert_id", 8)


@query("feed_alerts", "P9", q.with_views("alerts", f"""
    SELECT {_ALERT_COLS} FROM alerts WHERE length(source_type) > 0 AND threat_level = 'critical' AND created_at >= {q.AS_OF} - INTERVAL 7 DAY"""))
def feed_alerts(lake: Lake):
    return m.public_alerts(m.feed_alerts(lake.alerts(), lake.as_of, dt.timedelta(days=7), level="critical"))


@query("recent_items", "P10 J1 O1 P6", q.with_views("items sources", f"""
    SELECT i.doc_id, i.source_id, s.name AS source_name, s.source_type, i.title, i.threat_level, i.threat_score, i.collected_at
    FROM items i JOIN sources s USING (source_id) WHERE s.owner_id = {OWNER_ID} AND i.collected_at >= {q.AS_OF} - INTERVAL 7 DAY
    ORDER BY i.collected_at DESC, i.doc_id LIMIT 200"""))
def recent_items(lake: Lake):
    return m.recent_items(lake.items(), m.owned(lake.sources(), OWNER_ID), lake.as_of, days=7, limit=200)


@query("items_with_source", "J1", q.with_views("items sources", """
    SELECT i.doc_id, s.name, s.source_type, s.owner_id, i.threat_score FROM items i JOIN sources s USING (source_id)"""))
def items_with_source(lake: Lake):
    sources = lake.sources().select("source_id", "name", "source_type", "owner_id")
    return join_dimension(lake.items().select("doc_id", "source_id", "threat_score"), sources, "source_id").drop("source_id")


@query("new_items", "J2 P14 W2", q.with_views("items", f"""
    , old AS (SELECT * FROM items WHERE collected_at < {q.AS_OF} - INTERVAL 10 DAY),
      twice AS (SELECT * FROM items UNION ALL SELECT * FROM items)
    SELECT DISTINCT source_id, source_type, external_id, title FROM twice t
    WHERE length(text) > 0 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.source_id = t.source_id AND o.source_type = t.source_type AND o.external_id = t.external_id)"""))
def new_items(lake: Lake):
    items = lake.items().select("doc_id", *m.ITEM_KEY, "title", "text", "collected_at")
    stored = items.where(F.col("collected_at") < m.ntz(lake.as_of - dt.timedelta(days=10)))
    return m.new_items(items.unionByName(items), stored).select(*m.ITEM_KEY, "title")


@query("first_sightings", "W2", """
    SELECT text_key, doc_id, source FROM (
        SELECT sha1(text) AS text_key, doc_id, source, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_sightings(lake: Lake):
    docs = lake.table("documents").select(F.sha1("text").alias("text_key"), "doc_id", "source")
    return first_by(docs, ["text_key"], ["doc_id"])


@query("nonempty_items", "P14", q.with_views("items", "SELECT source_id, count(*) AS n FROM items WHERE length(text) > 0 GROUP BY source_id"))
def nonempty_items(lake: Lake):
    return m.with_text(lake.items()).groupBy("source_id").agg(F.count("*").alias("n"))


@query("raised_alerts", "P11 P12 J8", q.with_views("items sources", """
    SELECT i.title, i.text AS description, i.threat_level, i.threat_score, s.url AS source, i.source_type, s.owner_id,
           i.source_id, s.name AS source_name, i.external_id, false AS is_read, false AS is_resolved, i.collected_at AS created_at
    FROM items i JOIN sources s USING (source_id) WHERE i.threat_score >= 0.6"""))
def raised_alerts(lake: Lake):
    alerts = m.raise_alerts(lake.items(), lake.sources())
    return alerts.select("*", "details.source_name", "details.external_id").drop("details")


@query("combined_feed", "U1 J3 P9", q.with_views("alerts items", f"""
    , a AS (SELECT * FROM alerts WHERE created_at >= {q.AS_OF} - INTERVAL 30 DAY)
    SELECT 'alert-' || alert_id AS feed_id, 'alert' AS kind, title, source_name, source_type, threat_level, threat_score, created_at AS at, is_resolved FROM a
    UNION ALL
    SELECT 'item-' || doc_id, 'scan', title, 'Source ' || source_id, source_type, threat_level, threat_score, collected_at, false
    FROM items i WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.title = i.title AND a.source_name = 'Source ' || i.source_id)"""))
def combined_feed(lake: Lake):
    items = lake.items().withColumn("source_name", F.concat(F.lit("Source "), "source_id"))
    return m.combined_feed(m.feed_alerts(lake.alerts(), lake.as_of, dt.timedelta(days=30)), items)


@query("name_conflicts", "J4", q.with_views("sources", """
    , c AS (SELECT DISTINCT o.source_id, owner_id + shift AS owner_id, name, source_type, url
            FROM (SELECT *, unnest([0, 1]) AS shift FROM sources) o
            UNION SELECT source_id || 'x', owner_id, name || ' copy', source_type, url FROM sources)
    SELECT c.source_id, c.owner_id, CASE WHEN EXISTS (SELECT 1 FROM sources s WHERE s.owner_id = c.owner_id AND s.name = c.name) THEN 'name exists' ELSE 'source exists' END AS problem
    FROM c WHERE EXISTS (SELECT 1 FROM sources s WHERE s.owner_id = c.owner_id AND (s.name = c.name OR (s.source_type = c.source_type AND s.url = c.url)))"""))
def name_conflicts(lake: Lake):
    sources = lake.sources().select("source_id", "owner_id", "name", "source_type", "url")
    moved = sources.withColumn("owner_id", F.col("owner_id") + 1)
    copies = sources.withColumn("source_id", F.concat("source_id", F.lit("x"))).withColumn("name", F.concat("name", F.lit(" copy")))
    candidates = sources.unionByName(moved).unionByName(copies)
    return m.name_conflicts(candidates, sources).select("source_id", "owner_id", "problem")


@query("duplicate_texts", "J4", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(lake: Lake):
    return m.duplicate_keys(lake.table("documents").select("text"), ["text"])


@query("owned_items", "J5", q.with_views("items sources", f"SELECT doc_id, source_id, source_type FROM items WHERE source_id IN (SELECT source_id FROM sources WHERE owner_id = {OWNER_ID})"))
def owned_items(lake: Lake):
    items = lake.items().select("doc_id", "source_id", "source_type")
    return m.of_sources(items, m.owned(lake.sources(), OWNER_ID))


@query("keyword_hits", "J9", q.with_views("items source_keywords", """
    SELECT i.doc_id, i.source_id, array_to_string(list_filter(k.keywords, lambda x: contains(lower(i.text), lower(x))), '|') AS matches
    FROM items i JOIN source_keywords k USING (source_id)"""))
def keyword_hits(lake: Lake):
    texts = lake.items().select("doc_id", "source_id", "text")
    return m.keyword_hits(texts, lake.source_keywords()).select("doc_id", "source_id", F.array_join("matches", "|").alias("matches"))


_UPDATES = f"SELECT doc_id AS alert_id, user_id % 5 AS owner_id, e.event_type, e.ts FROM documents d JOIN events e ON e.event_id = d.doc_id * {q.STEP}"


@query("marked_alerts", "M1", q.with_views("alerts", f"""
    , u AS ({_UPDATES})
    SELECT a.alert_id, a.owner_id, a.is_read OR coalesce(u.event_type = 'view', false) AS is_read,
           a.is_resolved OR coalesce(u.event_type = 'purchase', false) AS is_resolved, CASE WHEN u.event_type = 'purchase' THEN u.ts END AS resolved_at
    FROM alerts a LEFT JOIN u USING (alert_id, owner_id)"""))
def marked_alerts(lake: Lake):
    docs = lake.table("documents").select(F.col("doc_id").alias("alert_id"), (F.col("doc_id") * lake.step).alias("event_id"))
    action = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "resolve").otherwise("none")
    updates = docs.join(lake.events(), "event_id").select("alert_id", (F.col("user_id") % 5).alias("owner_id"), action.alias("action"), F.col("ts").alias("at"))
    return m.mark(lake.alerts(), updates).select("alert_id", "owner_id", "is_read", "is_resolved", "resolved_at")


@query("touched_sources", "M2", q.with_views("sources items", """
    SELECT s.source_id, s.is_active, max(i.collected_at) AS last_checked FROM sources s LEFT JOIN items i ON i.source_id = s.source_id AND s.is_active GROUP BY ALL"""))
def touched_sources(lake: Lake):
    active = lake.sources().where("is_active").select("source_id")
    polled = lake.items().select("source_id", F.col("collected_at").alias("checked_at"))
    polled = polled.groupBy("source_id").agg(F.max("checked_at").alias("checked_at")).join(active, "source_id", "left_semi")
    return m.touch(lake.sources().select("source_id", "is_active"), polled)


@query("deleted_source", "M3", q.with_views("sources", f"SELECT source_id, name, owner_id FROM sources WHERE NOT (source_id = 'src1' AND owner_id = {OWNER_ID})"))
def deleted_source(lake: Lake):
    return m.delete_source(lake.sources(), "src1", OWNER_ID).select("source_id", "name", "owner_id")


@query("reset_counts", "M3 J5", q.with_views("alerts items sources", f"""
    SELECT (SELECT count(*) FROM alerts WHERE owner_id = {OWNER_ID}) AS alerts_deleted,
           (SELECT count(*) FROM items WHERE source_id IN (SELECT source_id FROM sources WHERE owner_id = {OWNER_ID})) AS items_deleted"""))
def reset_counts(lake: Lake):
    return m.reset_owner(lake.alerts(), lake.items(), lake.sources(), OWNER_ID)[2]


@query("reset_remaining", "M3", q.with_views("items sources", f"""
    SELECT doc_id, source_id FROM items WHERE source_id NOT IN (SELECT source_id FROM sources WHERE owner_id = {OWNER_ID})"""))
def reset_remaining(lake: Lake):
    return m.reset_owner(lake.alerts(), lake.items(), lake.sources(), OWNER_ID)[1].select("doc_id", "source_id")


@query("label_levels", "J6", q.with_views("messages", "SELECT doc_id, label, CASE WHEN label = 'EXTREMIST' THEN 'high' ELSE 'low' END AS threat_level FROM messages"))
def label_levels(lake: Lake):
    from riskloom.sources.labelled import threat_level

    return lake.messages().select("doc_id", "label", threat_level(F.col("label")).alias("threat_level"))


@query("labelled_messages", "S9", q.with_views("messages", f"""
    SELECT doc_id, text, label FROM messages WHERE text IS NOT NULL AND length({q.strip('text')}) > 0"""))
def labelled_messages(lake: Lake):
    from riskloom.sources.labelled import normalize_labelled

    legacy = lake.messages().select("doc_id", "text", F.when(F.col("label") == "EXTREMIST", "Extremist").otherwise("NonExtremist").alias("category"))
    return normalize_labelled(legacy)


@query("rescored_levels", "P1 P2", q.with_views("items", f"SELECT doc_id, {q.level('threat_score')} AS threat_level FROM items"))
def rescored_levels(lake: Lake):
    return lake.items().select("doc_id", level_of(F.col("threat_score")).alias("threat_level"))
