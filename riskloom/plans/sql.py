"""SQL text of the same views and expressions, for the comparison engine."""

from __future__ import annotations

from riskloom.fixed_values import LEVEL_CUTS, ZONE
from riskloom.functions.text import NON_WORD, WS
from riskloom.plans.views import OWNER_ID, USER_ID

__all__ = ["OWNER_ID", "USER_ID", "WS", "with_views"]


def score(x: str) -> str:
    scaled = f"(CASE WHEN {x} > 1 AND {x} <= 100 THEN {x} / 100.0 ELSE {x} END)"
    return f"(CASE WHEN {x} IS NULL OR {scaled} < 0 THEN 0.0 WHEN {scaled} > 1 THEN 1.0 ELSE round({scaled}, 4) + 0.0 END)"


def level(x: str) -> str:
    cases = " ".join(f"WHEN {x} >= {cut} THEN '{name}'" for name, cut in LEVEL_CUTS)
    return f"(CASE {cases} ELSE 'low' END)"


def rnd(x: str, digits: int = 4) -> str:
    return f"round({x} + 1e-9, {digits})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{NON_WORD}'), lambda t: t <> '')"


def zoned(x: str) -> str:
    return f"({x} AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')"


def zone_day(x: str) -> str:
    return f"strftime({zoned(x)}, '%Y-%m-%d')"


def source_type(n: str) -> str:
    return f"(CASE {n} % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'telegram' WHEN 2 THEN 'url' ELSE 'reddit' END)"


AS_OF = "(SELECT max(ts) FROM events)"
STEP = "((SELECT count(*) FROM events) // (SELECT count(*) FROM documents))"

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sources": ((), f"""
        SELECT source AS source_id, 'Source ' || source AS name, 'https://feeds.example.org/' || source AS url,
               {source_type('n')} AS source_type, n % 5 AS owner_id, n % 7 <> 0 AS is_active, CAST(300 AS BIGINT) AS check_interval, n
        FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS n FROM documents)"""),
    "source_keywords": (("sources",), f"""
        SELECT s.source_id, s.name, s.owner_id, {words('b.text')}[1:2] AS keywords
        FROM sources s JOIN benchmark b ON b.item_id = s.n"""),
    "items": ((), f"""
        SELECT doc_id, source_id, lang, title, text, source_type,
               source_type || ':' || substr(sha1(doc_id || '|' || title || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 24) AS external_id,
               threat_score, {level('threat_score')} AS threat_level, ts AS collected_at
        FROM (SELECT d.doc_id, d.source AS source_id, d.lang, substr(d.text, 1, 80) AS title, d.text, e.ts,
                     {source_type("CAST(substr(d.source, 4) AS BIGINT)")} AS source_type,
                     {score('e.value')} AS threat_score
              FROM documents d JOIN events e ON e.event_id = d.doc_id * {STEP})"""),
    "alerts": (("items",), """
        SELECT doc_id AS alert_id, title, text AS description, threat_level, threat_score, source_id, source_type,
               'Source ' || source_id AS source_name, 'https://feeds.example.org/' || source_id || '/' || doc_id AS source,
               CAST(substr(source_id, 4) AS BIGINT) % 5 AS owner_id,
               doc_id % 3 = 0 AS is_read, doc_id % 7 = 0 AS is_resolved, collected_at AS created_at
        FROM items WHERE threat_score >= 0.6"""),
    "analyses": ((), f"""
        SELECT event_id AS analysis_id, user_id,
               CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'document' WHEN 'purchase' THEN 'url'
                    WHEN 'signup' THEN 'rss' ELSE 'telegram' END AS analysis_type,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               {score('value')} AS threat_score, {level(score('value'))} AS threat_level, ts AS created_at
        FROM events"""),
    "doc_tokens": ((), f"""
        SELECT doc_id, pos, token FROM (
            SELECT doc_id, unnest({tokens('text')}) AS token, unnest(range(len({tokens('text')}))) AS pos FROM documents)"""),
    "doc_keywords": (("doc_tokens",), """
        SELECT doc_id, token AS keyword, rank FROM (
            SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank
            FROM doc_tokens WHERE regexp_full_match(token, '[a-z]{4,}') GROUP BY doc_id, token)
        WHERE rank <= 15"""),
    "messages": ((), """
        SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'EXTREMIST' ELSE 'NON_EXTREMIST' END AS label
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
    "message_rows": ((), f"""
        SELECT conv_id AS document_id, turn AS pos, {strip('text')} AS message
        FROM conversations WHERE length({strip('text')}) > 0"""),
    "model_scores": ((), f"""
        SELECT doc_id, source, n_chars % 101 / 100.0::DOUBLE AS length_score,
               round(len(list_distinct(list_transform({words('text')}, lambda x: lower(x)))) / greatest(len({words('text')}), 1) + 1e-9, 4) AS variety_score,
               (doc_id * 37) % 101 / 100.0::DOUBLE AS hash_score
        FROM documents"""),
    "model_scores_long": (("model_scores",), """
        SELECT doc_id, source, 'length' AS model, length_score AS score FROM model_scores
        UNION ALL SELECT doc_id, source, 'variety', variety_score FROM model_scores
        UNION ALL SELECT doc_id, source, 'hash', hash_score FROM model_scores"""),
    "features": (("messages",), f"""
        SELECT doc_id, label, length(text) AS msg_len, CAST(len(ws) AS BIGINT) AS word_count,
               list_sum(list_transform(ws, lambda x: length(x))) / nullif(len(ws), 0) AS avg_word_len,
               CAST(contains(text, '!') AS BIGINT) AS has_exclamation,
               CAST(len(list_filter(ws, lambda x: length(x) > 1 AND regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}]'))) > 0 AS BIGINT) AS has_caps_word,
               len(list_distinct(list_transform(ws, lambda x: lower(x)))) / greatest(len(ws), 1) AS unique_word_ratio,
               text
        FROM (SELECT doc_id, label, text, {words('text')} AS ws FROM messages)"""),
}


def with_views(names: str, body: str) -> str:
    """``WITH`` clause holding the named views and what they need, followed by ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    clauses = ",\n".join(f"{name} AS ({_VIEWS[name][1].strip()})" for name in ordered)
    extra = body.strip()
    if extra.startswith(","):
        return f"WITH {clauses}{extra}"
    return f"WITH {clauses}\n{extra}"
