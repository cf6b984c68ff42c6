"""Text, score and URL expressions against plain statements of their rules."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import arrays, scores, text, urls

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="abcXYZÉéñß19_ .,!?'\n\t-@# ", max_size=60), min_size=1, max_size=25)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def run(spark, values, expr, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expr(F.col("x"))).collect()]


@FEW
@given(TEXTS)
def test_tokens_and_words(spark, values):
    assert run(spark, values, text.tokens) == [re.findall(r"\w+", v.lower()) for v in values]
    assert run(spark, values, text.words) == [v.split() for v in values]


@FEW
@given(TEXTS)
def test_clean_and_sentences(spark, values):
    cleaned = [re.sub(r"\s+", " ", re.sub(r"[^\w\s.,!?;:'-]", " ", v)).strip() for v in values]
    assert run(spark, values, text.clean_text) == cleaned
    parts = [[s.strip() for s in re.split(r"(?<=[.!?])\s+", v) if s.strip()] for v in values]
    assert run(spark, values, text.sentences) == parts


@FEW
@given(TEXTS)
def test_truncate(spark, values):
    def rule(v, n=12):
        if len(v) <= n:
            return v
        head = v[:n]
        at = head.rfind(" ")
        return (head[:at] if at > 0 else head) + "..."

    assert run(spark, values, lambda c: text.truncate(c, 12)) == [rule(v) for v in values]


@FEW
@given(st.lists(st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta", "abc", "x1yz"]), max_size=40), min_size=1, max_size=10))
def test_keywords_rank_like_a_counter(spark, lists):
    values = [" ".join(x) for x in lists]
    expected = [[w for w, _ in Counter(re.findall(r"\b[a-z]{4,}\b", v)).most_common(3)] for v in values]
    assert run(spark, values, lambda c: text.top_keywords(c, 3)) == expected


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(-10, 200), st.sampled_from([0.0, 0.3, 0.6, 0.85, 1.0, 1.5, 100.0, 100.1])), min_size=1, max_size=30))
def test_score_rule(spark, values):
    got = run(spark, values, scores.normalize_score, "double")
    for v, g in zip(values, got):
        x = 0.0 if v is None else v / 100 if 1 < v <= 100 else v
        assert 0.0 <= g <= 1.0
        assert g == pytest.approx(min(max(x, 0.0), 1.0), abs=5.1e-5)


def test_scores_from_text(spark):
    assert run(spark, [None, "-1", "0", "0.3", "abc", "65.5", "100.1", "1.5"], scores.normalize_score) == [0.0, 0.0, 0.0, 0.3, 0.0, 0.655, 1.0, 0.015]


def test_level_bounds(spark):
    got = run(spark, [0.1, 0.3, 0.5, 0.5999, 0.6, 0.61, 0.8499, 0.85, 1.0], scores.level_of, "double")
    assert got == ["low", "medium", "medium", "medium", "high", "high", "high", "critical", "critical"]


def test_severity(spark):
    assert run(spark, [None, "", "HIGH", "Critical", "odd", "low"], scores.normalize_level) == ["low", "low", "high", "critical", "low", "low"]


def test_threat_labels(spark):
    got = run(spark, ["POSITIVE", "NEGATIVE", "LABEL_1", "LABEL_0", "severe_toxic", "not-hate", "joy"], scores.is_threat_label)
    assert got == [True, False, True, False, True, True, False]


def test_utility_examples(spark):
    assert run(spark, ["Hello   world!!  Test@#$  text"], text.clean_text) == ["Hello world!! Test text"]
    assert len(run(spark, ["First sentence. Second sentence! Third one?"], text.sentences)[0]) == 3
    cut = run(spark, ["word " * 100], lambda c: text.truncate(c, 50))[0]
    assert len(cut) <= 55 and cut.endswith("...")


def test_features(spark):
    df = column(spark, ["NASA says Hi! hi", "I am ok"]).withColumn("w", text.words(F.col("x")))
    rows = df.orderBy("i").select(*text.message_features(F.col("x"), F.col("w"))).collect()
    assert rows[0].asDict() == {"msg_len": 16, "word_count": 4, "avg_word_len": 3.25, "has_exclamation": 1, "has_caps_word": 1, "unique_word_ratio": 1.0}
    assert rows[1]["has_caps_word"] == 0  # a single capital letter is no capital word


def test_highlight_escapes(spark):
    got = run(spark, ["a+b A+B aab"], lambda c: text.highlight(c, F.array(F.lit("a+b"))))
    assert got == ["<mark>a+b</mark> <mark>A+B</mark> aab"]
    assert run(spark, ["x"], lambda c: text.highlight(c, F.array().cast("array<string>"))) == ["x"]


def test_accents(spark):
    assert run(spark, ["Étion ñandú straße ÀÖ é"], text.strip_accents) == ["Etion nandu straße AO e"]


def test_language(spark):
    values = ["the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el perro y los gatos", "zzz"]
    assert run(spark, values, text.detect_language) == ["en", "de", "fr", "es", "unknown"]


def test_bigrams(spark):
    assert run(spark, ["a b c", "a", ""], lambda c: arrays.bigrams(text.tokens(c))) == [["a b", "b c"], [], []]


def test_source_values(spark):
    cases = [
        ("reddit", "worldnews", "worldnews"), ("reddit", "r/worldnews", "worldnews"), ("reddit", " R/abc ", "abc"),
        ("reddit", "https://reddit.com/r/x1/new", "x1"), ("reddit", "https://reddit.com/u/x", None), ("reddit", "a", None),
        ("rss", "ftp://h", None), ("url", "http://", None), ("url", "https://h.example/p", "https://h.example/p"), ("rss", "  ", None), ("rss", None, None),
    ]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t string, v string")
    rows = df.orderBy("i").select(urls.normalize_source_value(F.col("t"), F.col("v")).alias("r")).select("r.*").collect()
    assert [r["value"] for r in rows] == [e for *_, e in cases]
    assert all((r["problem"] is None) == (r["value"] is not None) for r in rows)


def test_canonical_and_links(spark):
    assert run(spark, ["HTTPS://h.example/a/b/?q=1#f", "http://h.example/"], urls.canonical_url) == ["https://h.example/a/b", "http://h.example"]
    base = F.lit("https://h.example/a/b?q=1")
    got = run(spark, ["/c", "c", "//o.example/x", "?z=2", "#top", "mailto:me"], lambda c: urls.resolve_link(base, c))
    dotted = run(spark, ["../c", "./d?x=../y", "../../../e/./f/..", "g/.."], lambda c: urls.resolve_link(base, c))
    assert dotted == ["https://h.example/c", "https://h.example/a/d?x=../y", "https://h.example/e/", "https://h.example/a/"]
    assert got == ["https://h.example/c", "https://h.example/a/c", "https://o.example/x", "https://h.example/a/b?z=2", "https://h.example/a/b?q=1#top", "mailto:me"]


def test_flags(spark):
    assert run(spark, ["a@b.co", "a@b", "@b.co"], urls.is_email) == [True, False, False]
    assert run(spark, ["http://a.b/c", "https://a b", "ftp://a"], urls.is_url) == [True, False, False]


def test_model_score_chain(spark):
    schema = "own map<string,string>, per map<string,string>, model string, score string"
    rows = [({"a": "0.1", "b": "x"}, {"c": "0.2"}, "m", "0.3"), ({}, {"c": "0.2"}, "m", "0.3"), (None, None, "m", "0.3"), (None, None, None, "0.3"), (None, {"c": "x"}, "m", "bad")]
    df = spark.createDataFrame(rows, schema)
    got = df.select(scores.model_scores_or_fallback(F.col("own"), F.col("per"), F.col("model"), F.col("score"))).collect()
    assert [r[0] for r in got] == [{"a": 0.1}, {"c": 0.2}, {"m": 0.3}, None, None]


def test_summary(spark):
    df = spark.range(1)
    high = df.select(scores.summary_text(F.lit("high"), F.lit(0.625), F.lit("toxic"))).first()[0]
    assert high == "Threat level: HIGH (score: 0.63). Top label: toxic. Recommended: human review before action."
    low = df.select(scores.summary_text(F.lit("low"), F.lit(0.1), F.lit(None).cast("string"))).first()[0]
    assert low == "Threat level: LOW (score: 0.10). Top label: n/a."
