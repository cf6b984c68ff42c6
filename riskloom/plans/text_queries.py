"""Registered queries over text and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.fixed_values import LANGUAGE_WORDS, THREAT_LABELS, THREAT_TOKENS
from riskloom.functions import arrays, scores, text, times, urls
from riskloom.operators.frames import explode_once, join_dimension
from riskloom.operators.profile import with_features
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import Lake

WS = text.WS
BRIDGE = "https://bridge.example.org/channel/"


@query("clean_text", "F1", f"""
    SELECT doc_id, {q.strip(f"regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_{WS}.,!?;:''-]', ' ', 'g'), '[{WS}]+', ' ', 'g')")} AS cleaned
    FROM documents""")
def clean_text(lake: Lake):
    return lake.spread().select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("tokenize", "F2", f"SELECT doc_id, array_to_string({q.tokens('text')}, ' ') AS tokens, len({q.tokens('text')}) AS n FROM documents")
def tokenize(lake: Lake):
    t = text.tokens(F.col("text"))
    return lake.spread().select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query("sentences", "F3", f"""
    SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS pos, unnest(s) AS sentence FROM (
        SELECT doc_id, list_filter(list_transform(
            string_split(regexp_replace(text, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {q.strip('x')}), lambda x: x <> '') AS s
        FROM documents)""")
def sentences(lake: Lake):
    return lake.spread().select("doc_id", F.posexplode_outer(text.sentences(F.col("text"))).alias("pos", "sentence")).where(F.col("pos").isNotNull()).withColumn("pos", F.col("pos").cast("long"))


@query("truncate_text", "F4", """
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text
        WHEN strpos(reverse(substr(text, 1, 200)), ' ') > 0 AND 200 - strpos(reverse(substr(text, 1, 200)), ' ') > 0
        THEN substr(text, 1, 200 - strpos(reverse(substr(text, 1, 200)), ' ')) || '...'
        ELSE substr(text, 1, 200) || '...' END AS shortened FROM documents""")
def truncate_text(lake: Lake):
    return lake.table("documents").select("doc_id", text.truncate(F.col("text"), 200).alias("shortened"))


@query("message_features", "F5", q.with_views("features", f"""
    SELECT doc_id, label, msg_len, word_count, {q.rnd('avg_word_len', 6)} AS avg_word_len, has_exclamation, has_caps_word,
           {q.rnd('unique_word_ratio', 6)} AS unique_word_ratio FROM features"""))
def message_features(lake: Lake):
    wide = with_features(lake.messages())
    return (wide.withColumn("avg_word_len", scores.round_tie_up(F.col("avg_word_len"), 6))
            .withColumn("unique_word_ratio", scores.round_tie_up(F.col("unique_word_ratio"), 6)))


@query("punctuation_counts", "F6", """
    SELECT doc_id, length(text) - length(replace(text, '!', '')) AS exclamation_count,
           length(text) - length(replace(text, '?', '')) AS question_count,
           length(text) - length(replace(text, '.', '')) AS period_count,
           length(text) - length(replace(text, ',', '')) AS comma_count FROM documents""")
def punctuation_counts(lake: Lake):
    return lake.table("documents").select("doc_id", *text.punctuation_counts(F.col("text")))


@query("feed_item_ids", "F7", q.with_views("items", "SELECT doc_id, source_type, external_id FROM items"))
def feed_item_ids(lake: Lake):
    return lake.items().select("doc_id", "source_type", "external_id")


_PAGE_CANON = """rtrim(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' ||
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"""


@query("page_ids", "F8", f"""
    SELECT page_id, 'url:' || substr(sha1({_PAGE_CANON}), 1, 24) AS article_id,
           'url:' || url || ':' || substr(sha1(url || chr(10) || substr(html, 1, 500)), 1, 16) AS whole_page_id FROM pages""")
def page_ids(lake: Lake):
    url = F.col("url")
    return lake.table("pages").select(
        "page_id", urls.article_id(urls.canonical_url(url)).alias("article_id"),
        urls.page_id(url, url, F.col("html")).alias("whole_page_id"))


@query("canonical_urls", "F9", f"SELECT page_id, url, {_PAGE_CANON} AS canonical FROM pages")
def canonical_urls(lake: Lake):
    return lake.table("pages").select("page_id", "url", urls.canonical_url(F.col("url")).alias("canonical"))


@query("zone_times", "F10", f"""
    SELECT event_id, strftime({q.zoned('ts')}, '%d/%m/%Y, %H:%M:%S') AS local_time, strftime({q.zoned('ts')}, '%d/%m/%Y') AS local_date,
           {q.zone_day('ts')} AS file_date FROM events""")
def zone_times(lake: Lake):
    ts = F.col("ts")
    return lake.events().select("event_id", times.zone_datetime(ts).alias("local_time"), times.zone_date(ts).alias("local_date"), times.zone_day(ts).alias("file_date"))


@query("snippets", "F11", f"""
    SELECT doc_id, CASE WHEN length(flat) > 80 THEN substr(flat, 1, 80) || '…' ELSE flat END AS snippet
    FROM (SELECT doc_id, replace({q.strip('text')}, chr(10), ' ') AS flat FROM documents)""")
def snippets(lake: Lake):
    return lake.spread().select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("score_formats", "F12", q.with_views("analyses", """
    SELECT analysis_id, printf('%.1f', round(threat_score * 100 + 1e-9, 1)) || '%' AS percent, printf('%.4f', threat_score) AS fixed4 FROM analyses"""))
def score_formats(lake: Lake):
    score = F.col("threat_score")
    return lake.analyses().select("analysis_id", scores.percent_text(score).alias("percent"), F.format_string("%.4f", score).alias("fixed4"))


@query("list_parse", "F13", f"""
    SELECT doc_id, len(parts) AS n, array_to_string(parts, '|') AS parts FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {q.strip('x')}), lambda x: x <> '') AS parts FROM documents)""")
def list_parse(lake: Lake):
    parts = text.split_list(F.col("text"))
    return lake.spread().select("doc_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts"))


@query("word_counts", "F14", f"SELECT doc_id, len({q.words('text')}) AS word_count FROM documents")
def word_counts(lake: Lake):
    return lake.spread().select("doc_id", text.word_count(F.col("text")).alias("word_count"))


@query("label_argmax", "F15", q.with_views("model_scores_long", """
    SELECT doc_id, model AS top_label, score AS top_score, ranking FROM (
        SELECT doc_id, model, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, model) AS r,
               string_agg(model, '>') OVER (PARTITION BY doc_id ORDER BY score DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ranking
        FROM model_scores_long) WHERE r = 1"""))
def label_argmax(lake: Lake):
    m = F.col("model_scores")
    ordered = arrays.entries_by_value(m)
    return lake.model_scores().select(
        "doc_id", arrays.argmax_entry(m).alias("top_label"), F.array_max(F.map_values(m)).alias("top_score"),
        F.array_join(F.transform(ordered, lambda e: e["k"]), ">").alias("ranking"))


@query("score_normalise", "P1", f"SELECT event_id, {q.score('value')} AS score FROM events")
def score_normalise(lake: Lake):
    return lake.events().select("event_id", scores.normalize_score(F.col("value")).alias("score"))


@query("score_levels", "P2", q.with_views("analyses", "SELECT threat_level, count(*) AS n, min(threat_score) AS low, max(threat_score) AS high FROM analyses GROUP BY ALL"))
def score_levels(lake: Lake):
    return lake.analyses().groupBy("threat_level").agg(F.count("*").alias("n"), F.min("threat_score").alias("low"), F.max("threat_score").alias("high"))


_RAW_LEVEL_SQL = """CASE event_type WHEN 'signup' THEN 'CRITICAL' WHEN 'error' THEN 'High' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'unknown' END"""


@query("severity_normalise", "P3", f"""
    SELECT event_id, CASE WHEN lower(raw) IN ('critical','high','medium','low') THEN lower(raw) ELSE 'low' END AS severity
    FROM (SELECT event_id, {_RAW_LEVEL_SQL} AS raw FROM events)""")
def severity_normalise(lake: Lake):
    kind = F.col("event_type")
    raw = F.when(kind == "signup", "CRITICAL").when(kind == "error", "High").when(kind == "click", "medium").when(kind == "view", "unknown")
    return lake.events().select("event_id", scores.normalize_level(raw).alias("severity"))


@query("source_value_normalise", "P4", f"""
    WITH raw AS (
        SELECT doc_id, kind, CASE kind WHEN 'slug' THEN 'r/' || source WHEN 'community' THEN 'https://forum.example.org/r/' || source || '/new'
                 WHEN 'user' THEN 'https://forum.example.org/u/' || source WHEN 'short' THEN substr(source, 1, 1)
                 WHEN 'plain' THEN source ELSE 'http://' || source || '.example.org/feed' END AS value,
               CASE WHEN kind IN ('plain', 'web') THEN 'rss' ELSE 'reddit' END AS source_type
        FROM (SELECT doc_id, source, unnest(['slug','community','user','short','plain','web']) AS kind FROM documents))
    SELECT doc_id, kind,
        CASE WHEN kind = 'slug' THEN substr(value, 3) WHEN kind = 'community' THEN regexp_extract(value, '/r/([^/]+)', 1) WHEN kind = 'web' THEN value END AS accepted,
        CASE kind WHEN 'user' THEN 'not a community address' WHEN 'short' THEN 'bad community name' WHEN 'plain' THEN 'not an http address' END AS problem
    FROM raw""")
def source_value_normalise(lake: Lake):
    src = F.col("source")
    shapes = {
        "slug": ("reddit", F.concat(F.lit("r/"), src)),
        "community": ("reddit", F.concat(F.lit("https://forum.example.org/r/"), src, F.lit("/new"))),
        "user": ("reddit", F.concat(F.lit("https://forum.example.org/u/"), src)),
        "short": ("reddit", F.substring(src, 1, 1)),
        "plain": ("rss", src),
        "web": ("rss", F.concat(F.lit("http://"), src, F.lit(".example.org/feed"))),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("type"), v.alias("value")) for k, (t, v) in shapes.items()])
    long = lake.table("documents").select("doc_id", F.explode(cells).alias("c"))
    checked = urls.normalize_source_value(F.col("c.type"), F.col("c.value"))
    return long.select("doc_id", "c.kind", checked.alias("r")).select("doc_id", "kind", F.col("r.value").alias("accepted"), F.col("r.problem").alias("problem"))


@query("address_flags", "P5", r"""
    SELECT page_id, regexp_matches(url, '^https?://[^\s<>"{}|\\^`\[\]]+$') AS url_ok,
           regexp_matches(mail, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS mail_ok
    FROM (SELECT page_id, url, page_id || '@' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS mail FROM pages)""")
def address_flags(lake: Lake):
    mail = F.concat(F.col("page_id").cast("string"), F.lit("@"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1))
    return lake.table("pages").select("page_id", urls.is_url(F.col("url")).alias("url_ok"), urls.is_email(mail).alias("mail_ok"))


@query("model_score_fallback", "P7", q.with_views("analyses", """
    SELECT analysis_id, CASE analysis_type WHEN 'text' THEN 'own' WHEN 'document' THEN 'detail' WHEN 'url' THEN 'single' END AS model,
           CASE WHEN analysis_type IN ('text', 'document', 'url') THEN threat_score END AS score FROM analyses"""))
def model_score_fallback(lake: Lake):
    kind, score = F.col("analysis_type"), F.col("threat_score")
    empty = F.create_map().cast("map<string,string>")
    own = F.when(kind == "text", F.create_map(F.lit("own"), score.cast("string"), F.lit("broken"), F.lit("n/a"))).otherwise(empty)
    per_model = F.when(kind == "document", F.create_map(F.lit("detail"), score.cast("string")))
    model = F.when(kind == "url", F.lit("single"))
    picked = scores.model_scores_or_fallback(own, per_model, model, score)
    return lake.analyses().select(
        "analysis_id", F.get(F.map_keys(picked), F.lit(0)).alias("model"), F.get(F.map_values(picked), F.lit(0)).alias("score"))


@query("threat_labels", "P15", f"""
    SELECT DISTINCT token, (lower(token) IN ({', '.join(f"'{x}'" for x in THREAT_LABELS)}) OR regexp_matches(lower(token), '{'|'.join(THREAT_TOKENS)}')) AS threat
    FROM (SELECT unnest({q.tokens('text')}) AS token FROM documents
          UNION ALL SELECT CASE event_type WHEN 'signup' THEN 'LABEL_' || user_id % 3 WHEN 'error' THEN 'severe_' || user_id WHEN 'view' THEN 'POSITIVE' WHEN 'click' THEN 'Negative' ELSE 'hate-' || user_id END FROM events)""")
def threat_labels(lake: Lake):
    kind, user = F.col("event_type"), F.col("user_id")
    label = (F.when(kind == "signup", F.concat(F.lit("LABEL_"), user % 3)).when(kind == "error", F.concat(F.lit("severe_"), user))
             .when(kind == "view", "POSITIVE").when(kind == "click", "Negative").otherwise(F.concat(F.lit("hate-"), user)))
    found = explode_once(lake.spread(), [], text.tokens(F.col("text")), "token").union(lake.events().select(label))
    return found.distinct().select("token", scores.is_threat_label(F.col("token")).alias("threat"))


@query("summaries", "P16", q.with_views("analyses doc_keywords", f"""
    , kw AS (SELECT doc_id * {q.STEP} AS analysis_id, string_agg(keyword, ', ' ORDER BY rank) AS keywords FROM doc_keywords WHERE rank <= 10 GROUP BY doc_id)
    SELECT a.analysis_id,
        'Threat level: ' || upper(threat_level) || ' (score: ' || printf('%.2f', round(threat_score + 1e-9, 2)) || '). Top label: ' || analysis_type || '.'
        || CASE WHEN threat_level IN ('high', 'critical') THEN ' Recommended: human review before action.' ELSE '' END AS summary,
        'Scan report - ' || upper(threat_level) || ' threat (' || printf('%.1f', round(threat_score * 100 + 1e-9, 1)) || '%)' AS subject,
        coalesce(keywords, '—') AS keywords
    FROM analyses a LEFT JOIN kw USING (analysis_id)"""))
def summaries(lake: Lake):
    level, score = F.col("threat_level"), F.col("threat_score")
    joined = lake.analyses().join(lake.analysis_keywords(), "analysis_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "analysis_id", scores.summary_text(level, score, F.col("analysis_type")).alias("summary"),
        scores.report_subject(level, score).alias("subject"),
        scores.report_keywords(F.coalesce("keywords", none)).alias("keywords"))


@query("report_texts", "P16 F11 F12", q.with_views("doc_keywords model_scores", f"""
    , kw AS (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS keywords FROM doc_keywords WHERE rank <= 10 GROUP BY doc_id)
    SELECT doc_id, 'Hello reader,' || chr(10) || chr(10) || 'Your text scan has completed.' || chr(10) || chr(10) || 'Source: Text input: "' || CASE WHEN length(flat) > 80 THEN substr(flat, 1, 80) || '…' ELSE flat END || '"' || chr(10)
        || 'Threat level: ' || upper({q.level('hash_score')}) || chr(10) || 'Threat score: ' || printf('%.1f', round(hash_score * 100 + 1e-9, 1)) || '%' || chr(10)
        || CASE WHEN doc_id % 2 = 0 THEN 'Model: hash' || chr(10) ELSE '' END || chr(10) || 'Summary:' || chr(10) || '—' || chr(10) || chr(10) || 'Top keywords: ' || coalesce(keywords, '—') AS body
    FROM (SELECT doc_id, hash_score, replace({q.strip('text')}, chr(10), ' ') AS flat FROM documents JOIN model_scores USING (doc_id)) LEFT JOIN kw USING (doc_id)"""))
def report_texts(lake: Lake):
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0
    label = F.concat(F.lit('Text input: "'), text.snippet(F.col("text")), F.lit('"'))
    body = scores.report_body(
        F.lit("reader"), F.lit("text"), label, scores.level_of(score), score, F.lit(None).cast("string"), text.top_keywords(F.col("text")),
        F.when(F.col("doc_id") % 2 == 0, "hash").otherwise(""))
    return lake.spread().select("doc_id", body.alias("body"))


@query("highlight", "P17", q.with_views("items source_keywords", r"""
    SELECT i.doc_id, regexp_replace(i.text, '(?i)(' || array_to_string(list_transform(k.keywords, lambda x: regexp_replace(x, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')), '|') || ')',
           '<mark>\1</mark>', 'g') AS marked
    FROM items i JOIN source_keywords k USING (source_id)"""))
def highlight(lake: Lake):
    items = lake.items().select("doc_id", "source_id", "text")
    return join_dimension(items, lake.source_keywords().select("source_id", "keywords"), "source_id").select(
        "doc_id", text.highlight(F.col("text"), F.col("keywords")).alias("marked"))


@query("channel_addresses", "S7", f"""
    SELECT source_id, CASE WHEN starts_with(channel, 'http') THEN channel ELSE '{BRIDGE}' || ltrim(channel, '/') END AS feed_url,
           't.me/' || ltrim(channel, '/') AS source
    FROM (SELECT DISTINCT source AS source_id, CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0 THEN 'https://x.example.org/' || source
          WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 1 THEN '/' || source ELSE source END AS channel FROM documents)""")
def channel_addresses(lake: Lake):
    n = F.substring("source_id", 4, 18).cast("long")
    channel = F.when(n % 3 == 0, F.concat(F.lit("https://x.example.org/"), "source_id")).when(n % 3 == 1, F.concat(F.lit("/"), "source_id")).otherwise(F.col("source_id"))
    return lake.sources().select("source_id", urls.channel_feed_url(channel, BRIDGE).alias("feed_url"), urls.channel_label(channel).alias("source"))


_LANG_HITS = ", ".join(
    f"{{'h': -len(list_filter(ts, lambda t: t IN ({', '.join(repr(w) for w in ws)}))), 'lang': '{lang}'}}" for lang, ws in LANGUAGE_WORDS.items())


@query("language", "T15", f"""
    SELECT doc_id, lang, CASE WHEN best.h < 0 THEN best.lang ELSE 'unknown' END AS detected
    FROM (SELECT doc_id, lang, list_sort([{_LANG_HITS}])[1] AS best FROM (SELECT doc_id, lang, {q.tokens('text')} AS ts FROM documents))""")
def language(lake: Lake):
    return lake.spread().select("doc_id", "lang", text.detect_language(F.col("text")).alias("detected"))


@query("language_accuracy", "T15", f"""
    SELECT lang, count(*) AS n, count(*) FILTER (lang = CASE WHEN best.h < 0 THEN best.lang ELSE 'unknown' END) AS correct
    FROM (SELECT doc_id, lang, list_sort([{_LANG_HITS}])[1] AS best FROM (SELECT doc_id, lang, {q.tokens('text')} AS ts FROM documents)) GROUP BY lang""")
def language_accuracy(lake: Lake):
    found = lake.spread().select("lang", text.detect_language(F.col("text")).alias("detected"))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("detected")).alias("correct"))
