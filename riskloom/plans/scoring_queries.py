"""Registered scoring, ranking, TF-IDF and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scores import ensemble_mean, level_of, round_tie_up
from riskloom.operators import evaluation as ev
from riskloom.operators import scoring as sc
from riskloom.operators import splits, tfidf
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.views import Lake


def letter_share(letter: str):
    """Share of one letter in a piece of text, as a stand-in for a model's label score."""
    return lambda piece: (F.length(piece) - F.length(F.replace(piece, F.lit(letter), F.lit("")))) / F.length(piece)


def column_scorers() -> list:
    return [
        sc.ColumnScorer("letters_e", {"toxic": letter_share("e"), "calm": letter_share("o")}),
        sc.ColumnScorer("letters_n", {"hate": letter_share("n"), "threat": letter_share("t"), "neutral": letter_share("a")}),
    ]


def _share(x: str, letter: str) -> str:
    return f"(length({x}) - length(replace({x}, '{letter}', ''))) / length({x})"


# Scores of the two stand-in models for messages shorter than one chunk or longer, as SQL over (key, body).
def _scored(source: str, key: str, body: str) -> str:
    means = ", ".join(f"{q.rnd('avg(' + _share('c', letter) + ')')} AS s_{letter}" for letter in "eonta")
    return f"""
      pieces AS (SELECT {key}, substr(body, 4000 * unnest(range((length(body) + 3999) // 4000)) + 1, 4000) AS c
                 FROM (SELECT {key}, {q.strip(body)} AS body FROM {source})),
      scored AS (SELECT {key}, {means} FROM pieces GROUP BY {key}),
      models AS (SELECT {key}, s_e, s_o, s_a, s_n, s_t, s_e AS letters_e, greatest(s_n, s_t) AS letters_n, (s_e + greatest(s_n, s_t)) / 2 AS mean FROM scored)
"""


@query("long_text_scores", "A14 F15", f"""
    WITH {_scored('documents', 'doc_id', 'text')}
    SELECT doc_id, s_e AS toxic, s_o AS calm, s_e AS threat_score, {q.level('s_e')} AS threat_level, CASE WHEN s_o > s_e THEN 'calm'
           WHEN s_e > s_o THEN 'toxic' ELSE 'calm' END AS top_label FROM models""")
def long_text_scores(lake: Lake):
    docs = lake.spread().select("doc_id", "text")
    out = sc.classify(docs, "text", column_scorers()[:1])
    labels = F.col("label_scores")
    return out.select("doc_id", labels["toxic"].alias("toxic"), labels["calm"].alias("calm"), "threat_score", "threat_level", "top_label")


@query("multi_model_scores", "A13 A14", f"""
    WITH {_scored('documents', 'doc_id', 'text')}
    SELECT doc_id, letters_e, letters_n, {q.rnd('mean')} AS threat_score, {q.level('mean')} AS threat_level FROM models""")
def multi_model_scores(lake: Lake):
    out = sc.classify(lake.spread().select("doc_id", "text"), "text", column_scorers())
    each = [F.col("model_scores")[s].alias(s) for s in ("letters_e", "letters_n")]
    return out.select("doc_id", *each, "threat_score", "threat_level")


@query("ensemble_scores", "A13", q.with_views("model_scores", f"""
    SELECT doc_id, {q.rnd('mean')} AS threat_score, {q.level('mean')} AS threat_level FROM (SELECT doc_id, (length_score + variety_score + hash_score) / 3 AS mean FROM model_scores)"""))
def ensemble_scores(lake: Lake):
    mean = ensemble_mean(F.col("model_scores"))
    return lake.model_scores().select("doc_id", round_tie_up(mean).alias("threat_score"), level_of(mean).alias("threat_level"))


@query("weighted_ensemble", "A13", q.with_views("model_scores", f"""
    SELECT doc_id, {q.rnd('(length_score * 0.5 + variety_score * 0.3 + hash_score * 0.2) / 1.0')} AS threat_score FROM model_scores"""))
def weighted_ensemble(lake: Lake):
    mean = ensemble_mean(F.col("model_scores"), {"length": 0.5, "variety": 0.3, "hash": 0.2})
    return lake.model_scores().select("doc_id", round_tie_up(mean).alias("threat_score"))


@query("text_analysis", "T12 T13 P16 W4", q.with_views("doc_keywords", f"""
    , {_scored('documents', 'doc_id', 'text')}, kw AS (SELECT doc_id, string_agg(keyword, '|' ORDER BY rank) AS keywords FROM doc_keywords GROUP BY doc_id)
    SELECT d.doc_id, m.s_e AS threat_score, {q.level('m.s_e')} AS threat_level,
           'Threat level: ' || upper({q.level('m.s_e')}) || ' (score: ' || printf('%.2f', round(m.s_e + 1e-9, 2)) || '). Top label: ' ||
           CASE WHEN s_e > s_o THEN 'toxic' ELSE 'calm' END || '.' || CASE WHEN m.s_e >= 0.6 THEN ' Recommended: human review before action.' ELSE '' END AS summary,
           coalesce(kw.keywords, '') AS keywords, len({q.words('d.text')}) AS word_count
    FROM documents d JOIN models m USING (doc_id) LEFT JOIN kw USING (doc_id)"""))
def text_analysis(lake: Lake):
    out = sc.analyze(lake.spread().select("doc_id", "text"), "text", column_scorers()[:1])
    return out.select("doc_id", "threat_score", "threat_level", "summary", F.array_join("keywords", "|").alias("keywords"), "word_count")


@query("document_keywords", "W4", q.with_views("doc_keywords", """
    SELECT doc_id, coalesce(string_agg(keyword, '|' ORDER BY rank), '') AS keywords FROM documents LEFT JOIN doc_keywords USING (doc_id) GROUP BY doc_id"""))
def document_keywords(lake: Lake):
    from riskloom.functions.text import top_keywords

    listed = lake.spread().select("doc_id", top_keywords(F.col("text")).alias("k"))
    return listed.select("doc_id", F.array_join("k", "|").alias("keywords"))


_ROWS = """
      numbered AS (SELECT document_id, pos, message, row_number() OVER (PARTITION BY document_id ORDER BY pos) + 1 AS row FROM message_rows),
"""


@query("first_rows", "W1", q.with_views("message_rows", ", " + _ROWS.strip().rstrip(",") + " SELECT document_id, pos, row FROM numbered WHERE row < 5"))
def first_rows(lake: Lake):
    return sc.numbered_rows(lake.message_rows(), limit=3).select("document_id", "pos", "row")


@query("row_results", "T16 S1", q.with_views("message_rows", ", " + _ROWS + _scored("numbered", "document_id, row, message", "message") + f"""
    SELECT document_id, row, message, {q.rnd('mean')} AS threat_score, {q.level('mean')} AS threat_level, letters_e, letters_n FROM models"""))
def row_results(lake: Lake):
    out = sc.score_rows(lake.message_rows(), column_scorers())
    each = [F.col("model_scores")[s].alias(s) for s in ("letters_e", "letters_n")]
    return out.select("document_id", "row", "message", "threat_score", "threat_level", *each)


@query("table_roll_up", "A12 T16", q.with_views("message_rows", ", " + _scored("message_rows", "document_id, pos, message", "message") + f"""
    , r AS (SELECT document_id, avg({q.rnd('mean')}) AS m, count(*) AS row_count, CAST(sum(len({q.words('message')})) AS BIGINT) AS word_count FROM models GROUP BY document_id)
    SELECT document_id, {q.rnd('m')} AS threat_score, {q.level('(m + 1e-9)')} AS threat_level, row_count, word_count,
           'Document analysis: ' || row_count || ' rows analysed. Average threat score: ' || printf('%.4f', {q.rnd('m')}) || ' (' || upper({q.level('(m + 1e-9)')}) || ').' AS summary FROM r"""))
def table_roll_up(lake: Lake):
    return sc.roll_up(lake.message_rows(), column_scorers())


@query("table_model_means", "A12", q.with_views("message_rows", ", " + _scored("message_rows", "document_id, pos, message", "message") + f"""
    SELECT document_id, 'letters_e' AS model, {q.rnd('avg(letters_e)')} AS mean_score FROM models GROUP BY document_id
    UNION ALL SELECT document_id, 'letters_n', {q.rnd('avg(letters_n)')} FROM models GROUP BY document_id"""))
def table_model_means(lake: Lake):
    return sc.model_means(lake.message_rows(), column_scorers())


@query("table_keywords", "W4 T16", q.with_views("message_rows", f"""
    , t AS (SELECT document_id, pos, unnest(ts) AS keyword, unnest(range(len(ts))) AS place FROM (
        SELECT document_id, pos, list_filter({q.tokens('message')}, lambda t: regexp_full_match(t, '[a-z]{{4,}}')) AS ts FROM message_rows))
    SELECT document_id, keyword, n, rank FROM (SELECT document_id, keyword, count(*) AS n,
        row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, min(row(pos, place))) AS rank FROM t GROUP BY document_id, keyword) WHERE rank <= 15"""))
def table_keywords(lake: Lake):
    return sc.document_keywords(lake.message_rows())


@query("report_models", "A36", q.with_views("model_scores_long", f"""
    SELECT doc_id, string_agg(model || '=' || printf('%.4f', score), ', ' ORDER BY score DESC, model) AS models FROM model_scores_long GROUP BY doc_id"""))
def report_models(lake: Lake):
    from riskloom.functions.arrays import entries_by_value

    cells = F.transform(entries_by_value(F.col("model_scores")), lambda e: F.concat(e["k"], F.lit("="), F.format_string("%.4f", -e["v"])))
    return lake.model_scores().select("doc_id", F.array_join(cells, ", ").alias("models"))


@query("model_names", "A36", q.with_views("model_scores_long", "SELECT source, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM model_scores_long WHERE score > 0.3 GROUP BY source"))
def model_names(lake: Lake):
    long = lake.model_scores().select("source", F.explode_outer("model_scores").alias("model", "score")).where(F.col("model").isNotNull()).where(F.col("score") > 0.3)
    return long.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


_GRAMS = f"""
    toks AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '{q.NON_WORD}'), lambda t: length(t) >= 2) AS ts FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(ts) AS term FROM toks UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) FROM toks)
        GROUP BY doc_id, term),
    vocab AS (SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM (
        SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.95 * (SELECT count(*) FROM documents)
        ORDER BY cf DESC, term LIMIT 30000)),
    raw AS (SELECT doc_id, term, (ln(tf) + 1.0) * idf AS w FROM tf JOIN vocab USING (term)),
    weighted AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)
"""


@query("tfidf_vocabulary", "T1", f"WITH {_GRAMS} SELECT term, df, {q.rnd('idf', 8)} AS idf FROM vocab")
def tfidf_vocabulary(lake: Lake):
    counts = tfidf.counted(lake.spread(), keep=[])
    return tfidf.vocabulary(counts, counts.count()).select("term", "df", round_tie_up(F.col("idf"), 8).alias("idf"))


@query("tfidf_weights", "T1", f"WITH {_GRAMS} SELECT doc_id, term, {q.rnd('weight', 6)} AS weight FROM weighted")
def tfidf_weights(lake: Lake):
    return tfidf.tfidf(lake.spread(), "doc_id").withColumn("weight", round_tie_up(F.col("weight"), 6))


def _attributed(lake: Lake):
    """Contributions of a linear model whose coefficients follow from the terms."""
    counts = tfidf.counted(lake.spread(), keep=["doc_id"])
    model = tfidf.TfidfModel.fit_counted(counts)
    return model.contributions(counts, [(len(t) - 6) / 10.0 for t in model.terms])


_FIXED_MODEL = "c AS (SELECT doc_id, term, weight * ((length(term) - 6) / 10.0::DOUBLE) AS contribution FROM weighted)"


@query("attribution_margins", "T14", f"""
    WITH {_GRAMS}, {_FIXED_MODEL} SELECT doc_id, round(sum(contribution) + 0.05 + 1e-9, 6) AS margin, count(*) AS terms FROM c GROUP BY doc_id""")
def attribution_margins(lake: Lake):
    own = _attributed(lake).where(F.size("term") > 0)
    return own.select("doc_id", round_tie_up(tfidf.margin(0.05), 6).alias("margin"), F.size("term").cast("long").alias("terms"))


@query("term_contributions", "T14", f"WITH {_GRAMS}, {_FIXED_MODEL} SELECT doc_id, term, {q.rnd('contribution', 6)} AS contribution FROM c")
def term_contributions(lake: Lake):
    return tfidf.term_contributions(_attributed(lake), "doc_id").withColumn("contribution", round_tie_up(F.col("contribution"), 6))


_RANKED = """
    , ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM messages)
"""


@query("train_test_split", "T2", q.with_views("messages", _RANKED + "SELECT doc_id, label, r < floor(n * 0.2::DOUBLE + 0.5) AS is_test FROM ranked"))
def train_test_split(lake: Lake):
    return splits.split(lake.messages().select("doc_id", "label"), "doc_id")


@query("fold_assignment", "T3", q.with_views("messages", _RANKED + "SELECT doc_id, label, CAST(r % 5 AS INT) AS fold FROM ranked"))
def fold_assignment(lake: Lake):
    return splits.folds(lake.messages().select("doc_id", "label"), "doc_id")


@query("balanced_weights", "T4", q.with_views("messages", f"""
    SELECT label, count(*) AS n, {q.rnd('(SELECT count(*) FROM messages) / ((SELECT count(DISTINCT label) FROM messages) * count(*))', 6)} AS weight FROM messages GROUP BY label"""))
def balanced_weights(lake: Lake):
    messages = lake.messages().select("doc_id", "label")
    weighted = messages.withColumn("weight", splits.weight_column(splits.class_weights(messages)))
    return weighted.groupBy("label").agg(F.count("*").alias("n"), round_tie_up(F.max("weight"), 6).alias("weight"))


LABELS = ["EXTREMIST", "NON_EXTREMIST"]
_PREDICTIONS = """
    , predictions AS (SELECT m.doc_id, m.label, s.model, s.score, CASE WHEN s.score >= 0.5 THEN 'EXTREMIST' ELSE 'NON_EXTREMIST' END AS prediction
                      FROM messages m JOIN model_scores_long s USING (doc_id))
"""


def predictions(lake: Lake):
    """One prediction per labelled message and column scorer."""
    long = lake.model_scores().select("doc_id", F.explode_outer("model_scores").alias("model", "score")).where(F.col("model").isNotNull())
    joined = lake.messages().select("doc_id", "label").join(long, "doc_id")
    return joined.withColumn("prediction", F.when(F.col("score") >= 0.5, LABELS[0]).otherwise(LABELS[1]))


@query("confusion_matrix", "A26", q.with_views("messages model_scores_long", _PREDICTIONS + """
    SELECT model, label, count(*) FILTER (prediction = 'EXTREMIST') AS "predicted_EXTREMIST", count(*) FILTER (prediction = 'NON_EXTREMIST') AS "predicted_NON_EXTREMIST" FROM predictions GROUP BY model, label"""))
def confusion_matrix(lake: Lake):
    return ev.confusion(predictions(lake), LABELS, ["model"])


_REPORT = _PREDICTIONS + """
    , names AS (SELECT unnest(['EXTREMIST', 'NON_EXTREMIST']) AS name),
      base AS (SELECT model, name, count(*) FILTER (label = name) AS support, count(*) FILTER (label = name AND prediction = name) AS hit, count(*) FILTER (prediction = name) AS said
               FROM (SELECT p.*, unnest(['EXTREMIST', 'NON_EXTREMIST']) AS name FROM predictions p) GROUP BY model, name),
      pr AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM base),
      report AS (SELECT model, name, support, hit, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)
"""
_AVERAGES = """
    sum(hit) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1"""


@query("class_report", "A27", q.with_views("messages model_scores_long", _REPORT + f"""
    SELECT model, name, support, hit, {q.rnd('precision', 6)} AS precision, {q.rnd('recall', 6)} AS recall, {q.rnd('f1', 6)} AS f1 FROM report"""))
def class_report(lake: Lake):
    return ev.rounded(ev.class_report(predictions(lake), ["model"]), 6)


_AVG_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


@query("report_averages", "A27", q.with_views("messages model_scores_long", _REPORT + f"""
    SELECT model, {', '.join(f'{q.rnd(c, 6)} AS {c}' for c in _AVG_COLS)}, support FROM (SELECT model, {_AVERAGES}, CAST(sum(support) AS BIGINT) AS support FROM report GROUP BY model)"""))
def report_averages(lake: Lake):
    return ev.rounded(ev.averages(ev.class_report(predictions(lake), ["model"]), ["model"]), 6)


@query("roc_auc", "A28 W6", q.with_views("messages model_scores_long", _PREDICTIONS + f"""
    , ranks AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r FROM predictions)
    SELECT model, {q.rnd("(sum(r) FILTER (label = 'EXTREMIST') - count(*) FILTER (label = 'EXTREMIST') * (count(*) FILTER (label = 'EXTREMIST') + 1) / 2) / (count(*) FILTER (label = 'EXTREMIST') * count(*) FILTER (label <> 'EXTREMIST'))", 6)} AS auc
    FROM ranks GROUP BY model"""))
def roc_auc(lake: Lake):
    return ev.rounded(ev.roc_auc(predictions(lake), "EXTREMIST", ["model"]), 6)


@query("mid_ranks", "W6", q.with_views("model_scores_long", """
    SELECT model, doc_id, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS mid_rank FROM model_scores_long"""))
def mid_ranks(lake: Lake):
    from riskloom.operators.ranking import cumulative

    long = lake.model_scores().select("doc_id", F.explode_outer("model_scores").alias("model", "score")).where(F.col("model").isNotNull())
    counts = long.groupBy("model", "score").agg(F.count("*").alias("n"))
    ranked = cumulative(counts, ["model"], "score", ["n"])
    mid = F.col("before_n") + (F.col("n") + 1) / 2
    return long.join(ranked.select("model", "score", mid.alias("mid_rank")), ["model", "score"]).drop("score")


_FOLD_SQL = _RANKED + ", " + _PREDICTIONS.strip().lstrip(",") + f"""
    , fp AS (SELECT p.*, CAST(r.r % 5 AS INT) AS fold FROM predictions p JOIN ranked r USING (doc_id)),
      base AS (SELECT model, fold, name, count(*) FILTER (label = name) AS support, count(*) FILTER (label = name AND prediction = name) AS hit, count(*) FILTER (prediction = name) AS said
               FROM (SELECT p.*, unnest(['EXTREMIST', 'NON_EXTREMIST']) AS name FROM fp p) GROUP BY model, fold, name),
      pr AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM base WHERE support + said > 0),
      report AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr),
      per_fold AS (SELECT model, fold, {_AVERAGES} FROM report GROUP BY model, fold),
      summary AS (SELECT model, {q.rnd('avg(accuracy)', 6)} AS accuracy_mean, {q.rnd('stddev_pop(accuracy)', 6)} AS accuracy_std,
                         {q.rnd('avg(weighted_f1)', 6)} AS weighted_f1_mean, {q.rnd('stddev_pop(weighted_f1)', 6)} AS weighted_f1_std FROM per_fold GROUP BY model)
"""


def _cv_summary(lake: Lake):
    folded = splits.folds(lake.messages().select("doc_id", "label"), "doc_id").select("doc_id", "fold")
    report = ev.class_report(predictions(lake).join(folded, "doc_id"), ["model", "fold"])
    per_fold = ev.averages(report, ["model", "fold"])
    return ev.rounded(ev.fold_summary(per_fold, ["model"], ["accuracy", "weighted_f1"]), 6)


@query("cross_validation", "A29", q.with_views("messages model_scores_long", _FOLD_SQL + "SELECT * FROM summary"))
def cross_validation(lake: Lake):
    return _cv_summary(lake)


@query("best_model", "A30", q.with_views("messages model_scores_long", _FOLD_SQL + "SELECT * FROM summary ORDER BY weighted_f1_mean DESC, model LIMIT 1"))
def best_model(lake: Lake):
    return ev.best(_cv_summary(lake), "model", "weighted_f1_mean")


@query("leaderboard", "J10 A30", q.with_views("messages model_scores_long", _FOLD_SQL + f"""
    SELECT model, accuracy_mean, weighted_f1_mean, NULL::DOUBLE AS auc FROM summary
    UNION ALL SELECT model || ' (ranking)', NULL, NULL, {q.rnd("(sum(r) FILTER (label = 'EXTREMIST') - count(*) FILTER (label = 'EXTREMIST') * (count(*) FILTER (label = 'EXTREMIST') + 1) / 2) / (count(*) FILTER (label = 'EXTREMIST') * count(*) FILTER (label <> 'EXTREMIST'))", 6)}
    FROM (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r FROM predictions) GROUP BY model"""))
def leaderboard(lake: Lake):
    first = _cv_summary(lake).select("model", "accuracy_mean", "weighted_f1_mean")
    second = ev.rounded(ev.roc_auc(predictions(lake), "EXTREMIST", ["model"]), 6).withColumn("model", F.concat("model", F.lit(" (ranking)")))
    return first.unionByName(second, allowMissingColumns=True)
