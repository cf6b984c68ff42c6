"""Statistics of labelled text.

All distribution statistics start from ``feature_counts``: one row per class,
feature and distinct value.  The text is read once, and what follows works on
that much smaller table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.fixed_values import ENGLISH_STOP_WORDS
from riskloom.functions.arrays import bigrams, let
from riskloom.functions.scores import round_tie_up
from riskloom.functions.text import message_features, punctuation_counts, tokens, vector_tokens, words
from riskloom.operators.frames import explode_once, melt, merge_single_rows
from riskloom.operators.ranking import quantiles_of_counts, spread, top_k

FEATURES = ["msg_len", "word_count", "avg_word_len", "has_exclamation", "has_caps_word", "unique_word_ratio"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def with_features(messages: DataFrame) -> DataFrame:
    keep = [c for c in messages.columns if c != "text"]
    split = messages.select(*keep, "text", words(F.col("text")).alias("_words"))
    return split.select(*keep, *message_features(F.col("text"), F.col("_words")))


def feature_counts(messages: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(label, feature, value, n)."""
    long = melt(with_features(messages), ["label"], features)
    return long.groupBy("label", "feature", "value").agg(F.count("*").alias("n"))


def _over_classes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def _mean() -> Column:
    return F.sum(F.col("value") * F.col("n")) / F.sum("n")


def class_distribution(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("label", "n", round_tie_up(F.col("n") * 100 / total, 2).alias("percent"))


def length_statistics(counts: DataFrame) -> DataFrame:
    """Mean, median, smallest and largest value of each feature."""
    plain = _over_classes(counts)
    basic = plain.groupBy("feature").agg(_mean().alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    median = spread(quantiles_of_counts(plain, ["feature"], "value", "n", [0.5]), ["feature"], {"median": 0.5})
    return basic.join(median, "feature").select("feature", round_tie_up(F.col("mean"), 6).alias("mean"), round_tie_up(F.col("median"), 6).alias("median"), "low", "high")


def _fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    q = spread(quantiles_of_counts(counts, keys, "value", "n", list(QUARTILES.values())), keys, QUARTILES)
    step = (F.col("q3") - F.col("q1")) * 1.5
    return q.withColumn("lower", F.col("q1") - step).withColumn("upper", F.col("q3") + step)


def outliers(counts: DataFrame) -> DataFrame:
    """Tukey fences per feature, the rows outside them, and the rows above the upper one."""
    plain = _over_classes(counts)
    marked = plain.join(_fences(plain, ["feature"]), "feature")
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    above = F.when(F.col("value") > F.col("upper"), F.col("n")).otherwise(0)
    out = marked.groupBy("feature", "q1", "q3", "lower", "upper").agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outside"), F.sum(above).alias("above"), F.sum("n").alias("_n"))
    cols = [round_tie_up(F.col(c), 6).alias(c) for c in ("q1", "q3", "lower", "upper")]
    return out.select("feature", *cols, "outside", "above", round_tie_up(F.col("above") * 100 / F.col("_n"), 4).alias("percent_above"))


def box_statistics(counts: DataFrame) -> DataFrame:
    """Quartiles, whisker ends, mean and outlier count per class and feature."""
    marked = counts.join(_fences(counts, ["label", "feature"]), ["label", "feature"])
    inside = (F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper"))
    out = marked.groupBy("label", "feature", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        _mean().alias("mean"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"))
    cols = [round_tie_up(F.col(c), 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high", "mean")]
    return out.select("label", "feature", *cols, "outliers")


def histograms(counts: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Equal-width bins over each class's own range; the last bin includes its right edge."""
    chosen = counts.where(F.col("feature").isin(*bins))
    n_bins = F.create_map(*[x for k, v in bins.items() for x in (F.lit(k), F.lit(v))])[F.col("feature")]
    keys = ["label", "feature"]
    ranges = chosen.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn("bins", n_bins)
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")))
    slot = F.least(F.col("bins") - 1, F.coalesce(place, F.floor(F.col("bins") / 2))).cast("long").alias("bin")
    filled = chosen.join(ranges, keys).groupBy(*keys, slot).agg(F.sum("n").alias("n"))
    frame = ranges.select(*keys, "low", "high", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins").cast("long") - 1)).alias("bin"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    return frame.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", round_tie_up(F.col("low") + F.col("bin") * width, 6).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def density(counts: DataFrame, features: list[str], points: int = 1000) -> DataFrame:
    """Gaussian kernel density per class on an even grid, Scott bandwidth.

    The grid reaches half a range beyond both ends.  Each distinct value adds
    its weighted kernel to the fixed number of grid points, and these add up
    before the shuffle.
    """
    keys = ["label", "feature"]
    chosen = counts.where(F.col("feature").isin(*features))
    total, mean = F.sum("n"), _mean()
    square = F.sum(F.col("value") * F.col("value") * F.col("n"))
    shape = chosen.groupBy(*keys).agg(
        total.alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.sqrt((square - total * mean * mean) / F.nullif(total - 1, F.lit(0))).alias("std"))
    shape = shape.where(F.col("std") > 0).withColumn("bandwidth", F.col("std") * F.pow(F.col("rows"), F.lit(-0.2)))
    span = F.col("high") - F.col("low")
    x = F.col("low") - span * 0.5 + F.col("step") * (span * 2 / (points - 1))
    spread_out = chosen.join(shape, keys).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    z = (F.col("x") - F.col("value")) / F.col("bandwidth")
    out = spread_out.groupBy(*keys, "step", "x", "rows", "bandwidth").agg(F.sum(F.col("n") * F.exp(z * z * -0.5)).alias("mass"))
    level = F.col("mass") / (F.col("rows") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return out.select(*keys, F.col("step").cast("long").alias("step"), round_tie_up(F.col("x"), 4).alias("x"), round_tie_up(level * 1e6, 3).alias("density_ppm"))


def correlations(messages: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of features and the numeric label."""
    names = [*FEATURES, "label_numeric"]
    wide = with_features(messages).withColumn("label_numeric", (F.col("label") == "EXTREMIST").cast("int"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = wide.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], row.columns, "pair", "r")
    sides = F.split("pair", r"\|")
    a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    both = F.when(a == b, F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b"))))
    return long.select(F.explode(both).alias("p"), "r").select(
        F.col("p.a").alias("feature_a"), F.col("p.b").alias("feature_b"), F.round(F.col("r") + 1e-9, 5).alias("r"))


def class_means(messages: DataFrame) -> DataFrame:
    return with_features(messages).groupBy("label").agg(*[round_tie_up(F.avg(c), 6).alias(c) for c in FEATURES])


def punctuation_means(messages: DataFrame) -> DataFrame:
    counted = messages.select("label", *punctuation_counts(F.col("text")))
    marks = [c for c in counted.columns if c != "label"]
    return counted.groupBy("label").agg(*[round_tie_up(F.avg(c), 6).alias(c) for c in marks])


def quality(messages: DataFrame) -> DataFrame:
    """Missing values, repeated rows, repeated and unique messages.  Texts are compared by digest, so the shuffle stays narrow."""
    nulls = messages.agg(F.count_if(F.col("text").isNull()).alias("missing_text"), F.count_if(F.col("label").isNull()).alias("missing_label"))
    rows = messages.groupBy(F.sha2("text", 256).alias("digest"), "label").agg(F.count("*").alias("n"))
    texts = rows.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    totals = texts.agg(
        F.sum("n").alias("rows"), (F.sum("n") - F.sum("kinds")).alias("duplicate_rows"),
        (F.sum("n") - F.count("*")).alias("duplicate_messages"), F.count("digest").alias("unique_messages"))
    return merge_single_rows(nulls, totals)


def top_ngrams(messages: DataFrame, size: int, k: int, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Most frequent terms of each class after stop words are dropped; ties by term."""
    kept = F.filter(vector_tokens(F.col("text"), accents=False), lambda t: ~t.isin(list(stop_words)))
    terms = bigrams(kept) if size == 2 else kept
    counted = explode_once(messages, ["label"], terms, "term").groupBy("label", "term").agg(F.count("*").alias("n"))
    return top_k(counted, ["label"], [F.col("n").desc(), F.col("term")], k)


def numeric_profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Rows, missing, distinct values, range, mean and quartiles per numeric column."""
    if not exact:
        long = melt(df, [], columns, "column")
        cuts = F.percentile_approx("value", [0.25, 0.5, 0.75], 10000)
        out = long.groupBy("column").agg(
            F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.approx_count_distinct("value").alias("distinct_values"),
            F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), cuts.alias("cuts"))
        return out.select("*", *[F.get("cuts", F.lit(i)).alias(n) for i, n in enumerate(QUARTILES)]).drop("cuts")
    counts = melt(df, [], columns, "column").groupBy("column", "value").agg(F.count("*").alias("n"))
    basic = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_values"), F.min("value").alias("low"), F.max("value").alias("high"),
        (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"))
    q = spread(quantiles_of_counts(counts, ["column"], "value", "n", list(QUARTILES.values())), ["column"], QUARTILES)
    cells = [round_tie_up(F.col(c), 4).alias(c) for c in ("mean", *QUARTILES)]
    return basic.join(q, "column", "left").select("column", "rows", "missing", "distinct_values", "low", "high", *cells)


def category_profile(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Most frequent values of each text column."""
    long = df.select(*columns).unpivot([], columns, "column", "value").where(F.col("value").isNotNull())
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return top_k(counted, ["column"], [F.col("n").desc(), F.col("value")], k)


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of a table."""
    gaps = [F.col(c).isNull().cast("long") for c in df.columns]
    total = gaps[0]
    for g in gaps[1:]:
        total = total + g
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.sum(total).alias("missing_cells"))


def rule_score(text: Column, lexicon: dict[str, list[str]], density_weight: float = 10.0, diversity_bonus: float = 0.1) -> Column:
    """Keyword density times a weight, plus a bonus per further category, at most 1."""
    def score(ts: Column) -> Column:
        hits = [_hits(ts, ws) for ws in lexicon.values()]
        total = sum(hits[1:], hits[0])
        kinds = sum([(h > 0).cast("int") for h in hits[1:]], (hits[0] > 0).cast("int"))
        density = total / F.greatest(F.size(ts), F.lit(1))
        return F.least(F.lit(1.0), density * density_weight + F.greatest(kinds - 1, F.lit(0)) * diversity_bonus)

    return let(tokens(text), score)


def _hits(ts: Column, words: list[str]) -> Column:
    return F.size(F.filter(ts, lambda t: t.isin(list(words))))


def blend(model: Column, rule: Column, model_share: float = 0.7) -> Column:
    return model * model_share + rule * (1 - model_share)
