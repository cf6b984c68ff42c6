"""Scorers, chunking, ensembles and roll-ups."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.operators import scoring as sc
from riskloom.operators import tfidf

TEXTS = [(1, "short"), (2, "ab" * 3000 + "c" * 2500), (3, "   "), (4, "")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def share(letter):
    return lambda c: (F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))) / F.length(c)


def stub():
    return lambda pieces: [{"toxic": p.count("c") / len(p), "other": 0.9} for p in pieces]


def test_chunks_cover_the_text(spark):
    values = ["x" * 4000, "y" * 4001, "é\n" * 5000, " pad ", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.orderBy("i").select(sc.chunks(F.col("t")).alias("c")).collect()
    assert ["".join(r["c"]) for r in rows] == [v.strip() for v in values]
    assert [len(r["c"]) for r in rows] == [1, 2, 3, 1, 0]


def test_column_and_batch_scorers_agree(texts):
    column = sc.ColumnScorer("column", {"toxic": share("c"), "other": lambda c: F.lit(0.9)})
    batch = sc.BatchScorer("batch", stub)
    one = {r["doc_id"]: r for r in sc.classify(texts, "text", [column]).collect()}
    two = {r["doc_id"]: r for r in sc.classify(texts, "text", [batch]).collect()}
    expected = round((0 / 4000 + 500 / 2000 * 0 + 0) / 1, 4)
    body = TEXTS[1][1]
    expected = round(sum(body[i:i + 4000].count("c") / len(body[i:i + 4000]) for i in (0, 4000, 8000)) / 3, 4)
    assert one[2]["threat_score"] == two[2]["threat_score"] == pytest.approx(expected)
    assert one[2]["top_label"] == two[2]["top_label"] == "other"
    assert one[1]["label_scores"] == two[1]["label_scores"] == {"toxic": 0.0, "other": 0.9}


def test_blank_text_is_zero_and_low(texts):
    out = {r["doc_id"]: r for r in sc.analyze(texts, "text", [sc.ColumnScorer("c", {"toxic": share("c")})]).collect()}
    for i in (3, 4):
        assert (out[i]["threat_score"], out[i]["threat_level"], out[i]["keywords"], out[i]["language"]) == (0.0, "low", [], "unknown")


def test_frequent_words_become_keywords(spark):
    body = "Harbour harbour harbour: the crane crane lifted a crate."
    row = sc.analyze(spark.createDataFrame([(1, body)], "doc_id long, text string"), "text", [sc.ColumnScorer("c", {"toxic": share("t")})]).first()
    assert list(row["keywords"][:2]) == ["harbour", "crane"]
    assert row["threat_level"] == "low" and 0 <= row["threat_score"] < 0.3


def test_positive_counts_as_threat(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    pos = sc.ColumnScorer("s", {"POSITIVE": lambda c: F.lit(0.8), "NEGATIVE": lambda c: F.lit(0.9)})
    assert sc.classify(df, "text", [pos]).first()["threat_score"] == 0.8
    calm = sc.ColumnScorer("s", {"NEUTRAL": lambda c: F.lit(0.8)})
    assert sc.classify(df, "text", [calm]).first()["threat_score"] == 0.0


def test_level_comes_from_the_unrounded_mean(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    pair = [sc.ColumnScorer("a", {"toxic": lambda c: F.lit(0.5999)}), sc.ColumnScorer("b", {"toxic": lambda c: F.lit(0.6)})]
    row = sc.classify(df, "text", pair).first()
    assert (row["threat_score"], row["threat_level"], row["method"]) == (0.6, "medium", "multi_model")


def test_unknown_model_means_default():
    a, b = sc.ColumnScorer("a", {}), sc.ColumnScorer("b", {})
    models = sc.ScorerSet({"a": a, "b": b}, default="a")
    assert models.pick(None) == [a] and models.pick(["ensemble"]) == [a] and models.pick(["all"]) == [a, b] and models.pick(["b"]) == [b]


class Absent:
    """A model that could not be loaded."""

    name = "absent"

    def add(self, df, text, out):
        return df.withColumn(out, F.lit(None).cast("map<string,double>"))

    def threat(self, labels):
        return F.lit(0.5)


def test_missing_models_are_left_out(texts):
    present = sc.ColumnScorer("p", {"toxic": lambda c: F.lit(0.4)})
    row = sc.classify(texts, "text", [Absent(), present]).where("doc_id = 1").first()
    assert row["model_scores"] == {"p": 0.4} and row["threat_score"] == 0.4
    none = sc.analyze(texts, "text", [Absent()]).where("doc_id = 1").first()
    assert (none["method"], none["threat_score"], none["threat_level"]) == ("unavailable", 0.0, "low")
    assert none["summary"].startswith("ML classifier unavailable")


def test_pipeline_scorer(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer

    rows = [(i, "bad bad thing" if i % 2 else "good thing", float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y double")
    model = Pipeline(stages=[Tokenizer(inputCol="text", outputCol="w"), HashingTF(inputCol="w", outputCol="features", numFeatures=64), LogisticRegression(labelCol="y")]).fit(df)
    scorer = sc.PipelineScorer("lr", model, ("low", "high"))
    out = {r["doc_id"]: r["threat_score"] for r in sc.classify(df.select("doc_id", "text"), "text", [scorer]).collect()}
    assert out[1] > 0.9 > 0.1 > out[0]


def test_row_numbers_skip_blank_messages(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (1, 5, "d"), (2, 9, "z")], "document_id long, pos long, message string")
    got = sorted((r["document_id"], r["row"], r["message"]) for r in sc.numbered_rows(rows).collect())
    assert got == [(1, 2, "a"), (1, 3, "c"), (1, 4, "d"), (2, 2, "z")]
    assert sorted(r["message"] for r in sc.numbered_rows(rows, 2).collect()) == ["a", "c", "z"]


def test_roll_up(spark):
    rows = spark.createDataFrame([(1, 0, "cc"), (1, 1, "cx y"), (2, 0, "zzzz")], "document_id long, pos long, message string")
    out = {r["document_id"]: r for r in sc.roll_up(rows, [sc.ColumnScorer("c", {"toxic": share("c")})]).collect()}
    assert out[1]["threat_score"] == 0.625 and out[1]["threat_level"] == "high"
    assert (out[1]["row_count"], out[1]["word_count"]) == (2, 3)
    assert out[1]["summary"] == "Document analysis: 2 rows analysed. Average threat score: 0.6250 (HIGH)."


def test_document_keywords_break_ties_by_first_place(spark):
    rows = spark.createDataFrame([(1, 0, "beta alpha"), (1, 1, "alpha beta gamma gamma"), (1, 2, "zeta")], "document_id long, pos long, message string")
    got = [(r["rank"], r["keyword"]) for r in sc.document_keywords(rows, 4).orderBy("rank").collect()]
    assert got == [(1, "beta"), (2, "alpha"), (3, "gamma"), (4, "zeta")]


def test_tfidf_by_hand(spark):
    docs = ["red blue red", "blue Rèd", "green blue"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.tfidf(df, "doc_id", min_df=1, max_df=1.0).collect()}
    tokens = [["red", "blue", "red"], ["blue", "red"], ["green", "blue"]]
    grams = [Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]) for t in tokens]
    df_count = Counter(g for c in grams for g in c)
    for i, c in enumerate(grams):
        raw = {g: (1 + math.log(n)) * (math.log(4 / (1 + df_count[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for g, v in raw.items():
            assert got[(i, g)] == pytest.approx(v / norm)
    assert len(got) == sum(len(c) for c in grams)


def test_vectors_match_the_relation(spark, lake):
    messages = lake.messages()
    model = tfidf.TfidfModel.fit(messages)
    vectors = {r["doc_id"]: r["features"] for r in model.transform(messages).collect()}
    weights = tfidf.tfidf(messages, "doc_id").where("doc_id < 20").collect()
    assert weights
    slot = {t: i for i, t in enumerate(model.terms)}
    for r in weights:
        assert vectors[r["doc_id"]][slot[r["term"]]] == pytest.approx(r["weight"])
    empty = model.transform(spark.createDataFrame([(1, "")], "doc_id long, text string")).first()["features"]
    assert empty.size == model.size and empty.numNonzeros() == 0


def test_attribution_adds_up(spark):
    weights = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "a", 1.0)], "doc_id long, term string, weight double")
    coef = spark.createDataFrame([("a", 2.0), ("b", -1.0)], "term string, coefficient double")
    parts = tfidf.attribution(weights, coef, "doc_id")
    assert {r["doc_id"]: r["margin"] for r in tfidf.margins(parts, "doc_id", 0.5).collect()} == pytest.approx({1: 0.9, 2: 2.5})


@pytest.mark.parametrize("size", [1, 4, 7, 60, 1000])
def test_vocabulary_is_cut_by_frequency_then_name(spark, size):
    rng = random.Random(size)
    docs = [" ".join(rng.choices(["é", "Ab", "cd", "ef", "gh", "ij", "kl", "x", "m_1", "straße"], k=rng.choice([0, 1, 5, 300]))) for _ in range(40)] + [None, "", "cafe\u0301, cafe"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = [r["term"] for r in tfidf.vocabulary(tfidf.counted(df, keep=[]), len(docs), min_df=2, max_df=0.9, size=size).collect()]
    plain = {ord("é"): "e", 0x301: None}
    tokens = [[w for w in re.split(r"[^\w]+", (t or "").lower().translate(plain)) if len(w) > 1] for t in docs]
    grams = [Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]) for t in tokens]
    df_, cf = Counter(g for c in grams for g in c), sum(grams, Counter())
    kept = sorted((g for g in cf if 2 <= df_[g] <= 0.9 * len(docs)), key=lambda g: (-cf[g], g))
    assert sorted(got) == sorted(kept[:size])


def test_cut_of_high_frequencies(spark):
    values = [3, 3, 70, 71, 71, 5000, 5001, 123456789, 123456790, 123456791, 1 << 40, (1 << 40) + 1]
    kept = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "term string, cf long")
    for size in range(1, len(values)):
        cut = sorted(values, reverse=True)[size - 1]
        assert tfidf._cut(kept, size) == (cut, sum(v > cut for v in values))
    assert tfidf._cut(kept, len(values)) == (0, 0)


def test_tfidf_works_on_slices(spark, monkeypatch):
    """A batch is cut: no call sees more than the slice, and the weights are those of whole batches."""
    rows = [(n, " ".join(f"w{(n * k) % 41}" for k in range(1, 60))) for n in range(90)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, tfidf.tfidf(df, "doc_id").collect()))
    texts = pa.array([t for _, t in rows])
    monkeypatch.setattr(tfidf, "SLICE_BYTES", 500)
    parts = list(tfidf._count(iter([texts])))
    assert len(parts) > 30 and sum(map(len, parts)) == len(rows)
    monkeypatch.setattr(tfidf, "TERM_BYTES", 700)
    seen = []
    cut = list(tfidf._by_slices(lambda terms, tf: seen.append(len(terms)) or terms)(iter([(p.field(0), p.field(1)) for p in [pa.concat_arrays(parts)]])))
    assert len(seen) > 30 and sum(seen) == len(rows) == sum(map(len, cut))
    sliced = sorted(map(tuple, tfidf.tfidf(df, "doc_id").collect()))
    assert [r[:2] for r in sliced] == [r[:2] for r in whole] and [r[2] for r in sliced] == pytest.approx([r[2] for r in whole])


def test_plain_pieces_fold_one_by_one_only_beyond_ascii(monkeypatch):
    """ASCII pieces are lowered in one call; others follow Python's rules and the accent table, in their places."""
    pieces = ["Red", "Rèd", "", "STRASSE", "İx", "Straße", "ÀB", "日本", "m_1", "café"]
    want = [p.lower().translate(tfidf.ACCENT_MAP) for p in pieces]
    assert tfidf._plain(pa.array(pieces)).to_pylist() == want and len(tfidf._plain(pa.array([], pa.string()))) == 0
    monkeypatch.setattr(tfidf, "ACCENT_MAP", {ord("e"): "?"})
    assert tfidf._plain(pa.array(["Red", "Rède"])).to_pylist() == ["red", "rèd?"]
