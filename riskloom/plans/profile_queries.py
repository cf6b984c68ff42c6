"""Registered statistics of labelled text and generic table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.fixed_values import ENGLISH_STOP_WORDS
from riskloom.functions.scores import round_tie_up
from riskloom.operators import profile as p
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import Lake

_LONG = """
    , long AS (UNPIVOT (SELECT label, CAST(msg_len AS DOUBLE) AS msg_len, CAST(word_count AS DOUBLE) AS word_count, avg_word_len,
        CAST(has_exclamation AS DOUBLE) AS has_exclamation, CAST(has_caps_word AS DOUBLE) AS has_caps_word, unique_word_ratio FROM features)
        ON msg_len, word_count, avg_word_len, has_exclamation, has_caps_word, unique_word_ratio INTO NAME feature VALUE value)
"""


def _features(body: str) -> str:
    return q.with_views("features", _LONG + body)


@query("class_distribution", "A15 W5", q.with_views("messages", f"""
    SELECT label, count(*) AS n, {q.rnd('count(*) * 100 / (SELECT count(*) FROM messages)', 2)} AS percent FROM messages GROUP BY label"""))
def class_distribution(lake: Lake):
    return p.class_distribution(lake.messages())


@query("length_statistics", "A16", _features(f"""
    SELECT feature, {q.rnd('avg(value)', 6)} AS mean, {q.rnd('quantile_cont(value, 0.5)', 6)} AS median, min(value) AS low, max(value) AS high FROM long GROUP BY feature"""))
def length_statistics(lake: Lake):
    return p.length_statistics(p.feature_counts(lake.messages()))


_FENCES = """
    , fences AS (SELECT {keys}, q1, median, q3, q1 - (q3 - q1) * 1.5 AS lower, q3 + (q3 - q1) * 1.5 AS upper FROM (
        SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY {keys}))
"""


@query("outliers", "A17", _features(_FENCES.format(keys="feature") + f"""
    SELECT feature, {q.rnd('q1', 6)} AS q1, {q.rnd('q3', 6)} AS q3, {q.rnd('lower', 6)} AS lower, {q.rnd('upper', 6)} AS upper,
           count(*) FILTER (value < lower OR value > upper) AS outside, count(*) FILTER (value > upper) AS above, {q.rnd('count(*) FILTER (value > upper) * 100 / count(*)')} AS percent_above
    FROM long JOIN fences USING (feature) GROUP BY feature, q1, q3, lower, upper"""))
def outliers(lake: Lake):
    return p.outliers(p.feature_counts(lake.messages()))


_NUM = [*p.FEATURES, "label_numeric"]


@query("correlations", "A18", q.with_views("features", """
    , w AS (SELECT *, CASE WHEN label = 'EXTREMIST' THEN 1 ELSE 0 END AS label_numeric FROM features)
""" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}) + 1e-9, 5) AS r FROM w" for a in _NUM for b in _NUM)))
def correlations(lake: Lake):
    return p.correlations(lake.messages())


@query("class_feature_means", "A19", q.with_views("features", "SELECT label, " + ", ".join(f"{q.rnd(f'avg({f})', 6)} AS {f}" for f in p.FEATURES) + " FROM features GROUP BY label"))
def class_feature_means(lake: Lake):
    return p.class_means(lake.messages())


_BINS = {"msg_len": 50, "word_count": 50, "avg_word_len": 40, "unique_word_ratio": 40}


@query("histograms", "A20", _features(f"""
    , r AS (SELECT label, feature, min(value) AS low, max(value) AS high, CASE WHEN feature IN ('msg_len', 'word_count') THEN 50 ELSE 40 END AS bins
            FROM long WHERE feature IN ('msg_len', 'word_count', 'avg_word_len', 'unique_word_ratio') GROUP BY label, feature),
      h AS (SELECT label, feature, least(bins - 1, CASE WHEN high > low THEN CAST(floor((value - low) / (high - low) * bins) AS BIGINT) ELSE bins // 2 END) AS bin, count(*) AS n
            FROM long JOIN r USING (label, feature) GROUP BY ALL),
      f AS (SELECT label, feature, low, high, bins, unnest(range(bins)) AS bin FROM r)
    SELECT f.label, f.feature, f.bin, {q.rnd('f.low + f.bin * ((f.high - f.low) / f.bins)', 6)} AS left_edge, coalesce(h.n, 0) AS n
    FROM f LEFT JOIN h ON h.label = f.label AND h.feature = f.feature AND h.bin = f.bin"""))
def histograms(lake: Lake):
    return p.histograms(p.feature_counts(lake.messages(), list(_BINS)), _BINS)


@query("box_statistics", "A21", _features(_FENCES.format(keys="label, feature") + f"""
    SELECT label, feature, {q.rnd('q1', 6)} AS q1, {q.rnd('median', 6)} AS median, {q.rnd('q3', 6)} AS q3,
           {q.rnd('min(value) FILTER (value BETWEEN lower AND upper)', 6)} AS whisker_low, {q.rnd('max(value) FILTER (value BETWEEN lower AND upper)', 6)} AS whisker_high,
           {q.rnd('avg(value)', 6)} AS mean, count(*) FILTER (value NOT BETWEEN lower AND upper) AS outliers
    FROM long JOIN fences USING (label, feature) GROUP BY label, feature, q1, median, q3"""))
def box_statistics(lake: Lake):
    return p.box_statistics(p.feature_counts(lake.messages()))


@query("density_curves", "A22", _features(f"""
    , s AS (SELECT label, feature, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS bw, min(value) AS lo, max(value) AS hi
            FROM long WHERE feature IN ('msg_len', 'word_count') GROUP BY label, feature),
      c AS (SELECT label, feature, value, count(*) AS k FROM long GROUP BY ALL),
      g AS (SELECT *, lo - (hi - lo) * 0.5 + step * ((hi - lo) * 2 / 999) AS x FROM (SELECT *, unnest(range(1000)) AS step FROM s))
    SELECT g.label, g.feature, g.step, {q.rnd('g.x', 4)} AS x, {q.rnd('sum(k * exp(-0.5 * ((g.x - c.value) / bw) * ((g.x - c.value) / bw))) / (n * bw * sqrt(2 * pi())) * 1e6', 3)} AS density_ppm
    FROM g JOIN c ON c.label = g.label AND c.feature = g.feature GROUP BY g.label, g.feature, g.step, g.x, n, bw"""))
def density_curves(lake: Lake):
    return p.density(p.feature_counts(lake.messages(), ["msg_len", "word_count"]), ["msg_len", "word_count"])


@query("text_quality", "A23", q.with_views("messages", """
    SELECT count(*) FILTER (text IS NULL) AS missing_text, count(*) FILTER (label IS NULL) AS missing_label, count(*) AS rows,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, label FROM messages)) AS duplicate_rows,
           count(*) - count(DISTINCT text) AS duplicate_messages, count(DISTINCT text) AS unique_messages FROM messages"""))
def text_quality(lake: Lake):
    return p.quality(lake.messages())


@query("punctuation_means", "A24 F6", q.with_views("messages", "SELECT label, " + ", ".join(
    f"{q.rnd(f'''avg(length(text) - length(replace(text, '{c}', '')))''', 6)} AS {n}"
    for n, c in {"exclamation_count": "!", "question_count": "?", "period_count": ".", "comma_count": ","}.items()) + " FROM messages GROUP BY label"))
def punctuation_means(lake: Lake):
    return p.punctuation_means(lake.messages())


_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
_KEPT = f"list_filter(string_split_regex(lower(text), '{q.NON_WORD}'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"


def _ranked(terms: str, k: int) -> str:
    return q.with_views("messages", f"""
    , t AS (SELECT label, {_KEPT} AS ts FROM messages), e AS (SELECT label, unnest({terms}) AS term FROM t)
    SELECT label, term, n, rank FROM (SELECT label, term, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, term) AS rank
        FROM e GROUP BY label, term) WHERE rank <= {k}""")


@query("top_unigrams", "A25 W3", _ranked("ts", 20))
def top_unigrams(lake: Lake):
    return p.top_ngrams(lake.messages(), 1, 20)


@query("top_bigrams", "A25 W3", _ranked("list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])", 20))
def top_bigrams(lake: Lake):
    return p.top_ngrams(lake.messages(), 2, 20)


@query("term_frequency", "A25 W3", _ranked("ts", 25))
def term_frequency(lake: Lake):
    return p.top_ngrams(lake.messages(), 1, 25)


_LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("numeric_profile", "A37 A16", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,
        {q.rnd(f'avg({c})')} AS mean, {q.rnd(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q1, {q.rnd(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {q.rnd(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q3
    FROM lineitem""" for c in _LINE_NUM))
def numeric_profile(lake: Lake):
    return p.numeric_profile(lake.spread("lineitem", "l_orderkey"), _LINE_NUM)


_CATS = ["o_orderstatus", "o_orderpriority"]


@query("category_profile", "A37 W3", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders GROUP BY {c} QUALIFY rank <= 5""" for c in _CATS))
def category_profile(lake: Lake):
    return p.category_profile(lake.table("orders"), _CATS)


@query("table_shapes", "A37", " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, count(*) AS rows, CAST({n} AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells FROM {t}""" for t, n in {"customer": 5, "supplier": 4, "part": 6}.items()))
def table_shapes(lake: Lake):
    shapes = [p.table_shape(lake.table(t)).withColumn("table_name", F.lit(t)) for t in ("customer", "supplier", "part")]
    return shapes[0].unionByName(shapes[1]).unionByName(shapes[2])


_LEXICON = {"english": ["the", "and", "that"], "french": ["le", "des", "que"], "german": ["der", "und"], "spanish": ["los", "por"]}
_HITS = [f"len(list_filter(ts, lambda t: t IN ({', '.join(repr(w) for w in ws)})))" for ws in _LEXICON.values()]


@query("rule_scores", "A39", f"""
    SELECT doc_id, {q.rnd('rule', 6)} AS rule_score, {q.rnd('0.7 * ((n_chars % 101) / 100.0::DOUBLE) + 0.3 * rule', 6)} AS blended FROM (
        SELECT doc_id, n_chars, least(1.0::DOUBLE, ({' + '.join(_HITS)}) / greatest(len(ts), 1) * 10.0::DOUBLE
            + greatest({' + '.join(f'CAST({h} > 0 AS INT)' for h in _HITS)} - 1, 0) * 0.1::DOUBLE) AS rule
        FROM (SELECT doc_id, n_chars, {q.tokens('text')} AS ts FROM documents))""")
def rule_scores(lake: Lake):
    rule = p.rule_score(F.col("text"), _LEXICON)
    scored = lake.spread().select("doc_id", rule.alias("rule"), ((F.col("n_chars") % 101) / 100.0).alias("model"))
    return scored.select("doc_id", round_tie_up(F.col("rule"), 6).alias("rule_score"), round_tie_up(p.blend(F.col("model"), F.col("rule")), 6).alias("blended"))
