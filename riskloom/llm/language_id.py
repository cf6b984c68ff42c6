"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams (two to four bytes) of a lower-cased word between
boundary marks, hashed to buckets.  A text is the mean embedding of all its
subwords.  Embeddings and the linear layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled segments; a temperature and a
rejection threshold are calibrated on segments that were held back.  Prediction
reads every word of every text: since the model is linear up to the softmax,
each bucket's class scores are computed once, and each distinct word of a batch
once.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
and every text if no label was learned; ties go to the language first in
alphabetical order; rows with a null label are not learned from; a null key
counts as an empty one when the training rows are chosen; repeated rows agree.
``accepted`` is false where the calibrated score is below the threshold; the
prediction is reported all the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import received, shipped
from riskloom.llm.words import pieces_of, ragged, split_words, string_buffers, text_array

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSION = 16
SAMPLE_PER_LANGUAGE = 1200  # documents learned from, per language, about
SEGMENTS = 4  # segments taken from each of them
SEGMENT_WORDS = 24
LONGEST_WORD = 200  # bytes; longer words are not learned from
EPOCHS = 4  # at least, and
LEAST_STEPS = 800  # batches in any case
ACCURACY = 0.99  # wanted among accepted segments


@dataclass(frozen=True)
class Model:
    languages: list[str]
    bucket_scores: np.ndarray  # (BUCKETS, languages): embedding times linear layer
    bias: np.ndarray
    temperature: float
    threshold: float


def word_grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word end to end, and their number per word."""
    size = np.diff(offsets)
    marked = np.empty(len(raw) + 2 * len(size), np.uint64)
    first = offsets[:-1] + 2 * np.arange(len(size))
    marked[first], marked[first + size + 1] = 1, 2
    marked[ragged(first + 1, size)] = raw
    found, owner = [], []
    for n in GRAMS:
        number = np.maximum(size + 2 - n + 1, 0)
        at = ragged(first, number)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(1099511628211)) ^ marked[at + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owner.append(np.repeat(np.arange(len(size)), number))
    buckets, words = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(words, kind="stable")
    return buckets[order], np.bincount(words, minlength=len(size))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(segments: list[str], labels: list[str], seed: int = 11) -> Model:
    """Fit the model on labelled segments; a fifth of them calibrates it."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    truth = np.searchsorted(languages, labels)
    words, counts = split_words(pa.array(segments, pa.string()), lower=True)
    buckets, per_word = word_grams(*string_buffers(words))
    ends = np.append(0, np.cumsum(per_word))[np.append(0, np.cumsum(counts))]
    usable = rng.permutation(np.flatnonzero(np.diff(ends) > 0))
    held, learned = usable[: len(usable) // 5], usable[len(usable) // 5:]
    table = rng.normal(0, 1 / DIMENSION, (BUCKETS, DIMENSION))
    layer, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    size, done = 32, 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * size // max(1, len(learned))))
    total = epochs * len(learned)
    for _ in range(epochs if len(learned) else 0):
        learned = rng.permutation(learned)
        for at in range(0, len(learned), size):
            part = learned[at: at + size]
            rate = 1.0 * (1 - done / total)
            done += len(part)
            number = ends[part + 1] - ends[part]
            ids = buckets[ragged(ends[part], number)]
            mean = np.add.reduceat(table[ids], np.cumsum(number) - number, axis=0) / number[:, None]
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(part)), truth[part]] -= 1
            pull = (error @ layer.T) / number[:, None]
            layer -= rate * mean.T @ error / len(part)
            bias -= rate * error.mean(axis=0)
            known, place = np.unique(ids, return_inverse=True)
            owner = np.repeat(np.arange(len(part)), number)
            step = np.stack([np.bincount(place, pull[owner, d], len(known)) for d in range(DIMENSION)], axis=1)
            table[known] -= rate * step * 8
    model = Model(languages, (table @ layer).astype(np.float32), bias, 1.0, 0.0)
    return _calibrated(model, *_segment_scores(model, buckets, ends, held), truth[held])


def _segment_scores(m: Model, buckets: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray]:
    number = ends[rows + 1] - ends[rows]
    if not len(rows):
        return (np.zeros((0, len(m.languages))),)
    total = np.add.reduceat(m.bucket_scores[buckets[ragged(ends[rows], number)]].astype(float), np.cumsum(number) - number, axis=0)
    return (total / number[:, None] + m.bias,)


def _calibrated(m: Model, scores: np.ndarray, truth: np.ndarray) -> Model:
    """Temperature with the least held-out loss, and the least threshold with the wanted accuracy above it."""
    if not len(truth):
        return m
    grid = np.exp(np.linspace(-2.5, 2.5, 41))
    loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    chance = _softmax(scores / t)
    top, right = chance.max(axis=1), chance.argmax(axis=1) == truth
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCURACY
    threshold = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(m.languages, m.bucket_scores, m.bias, t, threshold)


def predict(texts: pa.Array, m: Model) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Language, calibrated score and acceptance of each text."""
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    words, counts = split_words(texts, lower=True)
    if not m.languages or not len(words):
        return pa.array([UNKNOWN] * len(texts), pa.string()), np.zeros(len(texts)), np.zeros(len(texts), bool)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    buckets, number = word_grams(*string_buffers(coded.dictionary))
    first = np.cumsum(number) - number
    owner = np.repeat(np.arange(len(counts)), counts)
    size = np.bincount(owner, number[code], len(counts))
    total = np.empty((len(counts), len(m.languages)))
    for k in range(len(m.languages)):
        word_score = np.add.reduceat(m.bucket_scores[buckets, k].astype(float), first)
        total[:, k] = np.bincount(owner, word_score[code], len(counts))
    chance = _softmax((total / np.maximum(size, 1)[:, None] + m.bias) / m.temperature)
    best = chance.argmax(axis=1)
    score = np.where(lettered, chance[np.arange(len(best)), best], 0.0)
    names = pa.array([*m.languages, UNKNOWN], pa.string()).take(pa.array(np.where(lettered, best, len(m.languages))))
    return names, score, lettered & (score >= m.threshold)


def training_segments(docs: DataFrame, text_col: str, label_col: str, per_language: int) -> DataFrame:
    """(segment, lang): word runs spread over the texts of about ``per_language`` labelled documents of each language."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled.select(F.col("text").alias("segment"), "lang").limit(0)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])[F.col("lang")]
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches):
        for batch in pieces_of(batches, "text"):
            words, counts = split_words(text_array(batch["text"]), lower=False)
            short = pc.less_equal(pc.binary_length(words), LONGEST_WORD)
            ends = np.append(0, np.cumsum(counts))
            segments, langs = [], []
            for row, lang in enumerate(batch["lang"].to_pylist()):
                for k in range(min(SEGMENTS, -(-int(counts[row]) // SEGMENT_WORDS))):
                    at = int(ends[row] + max(0, counts[row] - SEGMENT_WORDS) * k // max(1, SEGMENTS - 1))
                    run_ = slice(at, min(at + SEGMENT_WORDS, int(ends[row + 1])))
                    segments.append(" ".join(words[run_].filter(short[run_]).to_pylist()))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.string()), pa.array(langs, pa.string())], ["segment", "lang"])

    return chosen.mapInArrow(run, "segment string, lang string")


def train_on(docs: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the labelled rows of a table; the segments that reach the driver are bounded by the parameters."""
    rows = sorted((r["segment"], r["lang"]) for r in training_segments(docs, text_col, label_col, per_language).collect())
    return train([r[0] for r in rows], [r[1] for r in rows])


def fold(key: Column, folds: int) -> Column:
    """crc32 of a key as text, modulo the number of folds."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The given columns (but those named as the result's), lang_pred, score and accepted."""
    shared = shipped(docs.sparkSession, model)
    added = ["lang_pred", "score", "accepted"]

    def run(batches):
        fitted = received(shared)
        for batch in pieces_of(batches, "text"):
            lang, score, accepted = predict(text_array(batch["text"]), fitted)
            yield pa.RecordBatch.from_arrays([batch["row"], lang, pa.array(score), pa.array(accepted)], ["row", *added])

    kept = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("text"))
    made = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)
