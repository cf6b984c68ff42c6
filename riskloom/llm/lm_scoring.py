"""Language-model scores of whole texts by a causal self-attention model over subword ids.

One pass writes blocks: the distinct words of a slice of documents with their
pieces, how often each occurs in its training documents, and every text as codes
of these words.
Word counts, follower counts of subwords and the sums N and V come from all
blocks.  The attention model stands on the follower counts of the whole corpus
and learns from every place of every training text: it starts from weights
fitted to a bounded sample, each task takes further steps over all texts of its
blocks, and the weights are averaged by the places they have seen.  A last pass
brings the word counts back to their blocks and scores each text: texts are
never shuffled, and a frequent word costs one row per block.

Words are split into the pieces of a public model; they are lower-cased (A-Z)
and read without their white space, so a text's probability is that of its
words and its end.  Pieces outside the model's leaves share the last leaf by
their smoothed corpus shares.

Defined results: a null text counts as empty and has its end only; texts of any
length are scored whole; repeated rows agree; a null key counts as an empty one
when the training rows are chosen; without any training document the model
knows the smoothed priors alone, and N is 0.
"""

from __future__ import annotations

import secrets
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import attention_model as am
from riskloom.llm.sentencepieces import MODEL
from riskloom.llm.tables import received, shipped
from riskloom.llm.words import pieces_of, ragged, split_words, text_array
from riskloom.session import shared_dir

SAMPLE_DOCS = 3000  # training documents that the windows of the first weights are taken from, about
SAMPLE_WINDOWS = 8  # windows taken from each
STEPS = 1800
BLOCK_BYTES = 16 << 20
SLICE_WORDS = 20_000  # words split at a time
SLICE_TOKENS = 100_000  # words of text scored at a time, or one text
LAST = am.LEAVES - 1  # leaf of all further pieces


def _splitter(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def _word_pieces(splitter, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of words end to end, and their number per word."""
    pieces, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), SLICE_WORDS):
        ids = splitter.encode(words[at: at + SLICE_WORDS].to_pylist(), num_threads=1)
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        pieces.append(np.fromiter(chain.from_iterable(ids), np.int64, int(sizes[-1].sum())))
    return np.concatenate(pieces), np.concatenate(sizes)


def blocks(docs: DataFrame, model: str) -> DataFrame:
    """One row per slice of the rows (doc_id, learned, text): words, their pieces and training counts, and the texts as word codes."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        splitter, packer = _splitter(model), zstandard.ZstdCompressor(level=1)
        for batch in pieces_of(batches, "text", BLOCK_BYTES):
            words, counts = split_words(text_array(batch["text"]), lower=True)
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            learned = np.repeat(batch["learned"].to_numpy(zero_copy_only=False), counts)
            seen = np.bincount(code[learned], minlength=len(coded.dictionary))
            pieces, size = (packer.compress(x.astype(np.int32).tobytes()) for x in _word_pieces(splitter, coded.dictionary))
            one = {
                "block": [secrets.randbits(63)], "doc_id": [batch["doc_id"]], "learned": [batch["learned"]], "n_words": [counts],
                "codes": [packer.compress(code.tobytes())], "pieces": [pieces], "sizes": [size], "words": [coded.dictionary], "n": [seen]}
            schema = pa.schema([
                ("block", pa.int64()), ("doc_id", pa.list_(batch["doc_id"].type)), ("learned", pa.list_(pa.bool_())), ("n_words", pa.list_(pa.int64())),
                ("codes", pa.binary()), ("pieces", pa.binary()), ("sizes", pa.binary()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(v[0])], pa.int32()), pa.array(v[0], f.type.value_type)) if pa.types.is_list(f.type) else pa.array(v, f.type)
                for f, v in zip(schema, one.values())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            pa.default_memory_pool().release_unused()  # workers are kept between stages

    return docs.mapInArrow(run, f"block long, doc_id array<{key}>, learned array<boolean>, n_words array<long>, codes binary, pieces binary, sizes binary, words array<string>, n array<long>")


def _unpacked(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    """Whole numbers that a block holds compressed."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(batch[name][row].as_py()), np.int32).astype(np.int64)


def follower_counts(counts: DataFrame, model: str) -> DataFrame:
    """(a, b, n): how often piece b follows piece a inside a word; -1 is the edge of a word."""
    def run(batches):
        splitter = _splitter(model)
        for batch in batches:
            ids, size = _word_pieces(splitter, batch["word"])
            n = batch["n"].to_numpy().astype(np.int64)
            filled = size > 0
            n, size = n[filled], size[filled]
            edge = np.full(len(ids) + len(size), -1, np.int64)  # each word's pieces, then an edge
            edge[ragged(np.cumsum(size + 1) - (size + 1), size)] = ids
            before = np.append(-1, edge[:-1])
            weight = np.repeat(n, size + 1)
            pair, place = np.unique((before + 1) * (1 << 32) + edge + 1, return_inverse=True)
            total = np.bincount(place, weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((pair >> 32) - 1), pa.array((pair & 0xFFFFFFFF) - 1), pa.array(total)], ["a", "b", "n"])

    return counts.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Leaves:
    """Model leaf of every piece, of the end of a text, and log shares inside the last leaf."""

    def __init__(self, counts: dict[int, int], texts: int, vocabulary: int):
        size = np.zeros(vocabulary + 1)
        for piece, n in counts.items():
            size[piece] = n
        size[vocabulary] = max(1, texts)  # the end
        order = np.argsort(-size, kind="stable")
        self.leaf = np.full(vocabulary + 1, LAST, np.int64)
        self.leaf[order[:LAST]] = np.arange(LAST)
        rest = order[LAST:]
        self.inner = np.zeros(vocabulary + 1)
        if len(rest):
            self.inner[rest] = np.log(size[rest] + 0.5) - np.log((size[rest] + 0.5).sum())
        self.end = vocabulary


def _pair_table(rows: list, leaves: Leaves, texts: int) -> np.ndarray:
    """Counts (LEAVES + 1, LEAVES) of followers; after the end of a word any first piece may come, by its share."""
    table = np.zeros((am.LEAVES + 1, am.LEAVES))
    first, closing = np.zeros(am.LEAVES), np.zeros(am.LEAVES + 1)
    for a, b, n in rows:
        if a < 0:
            first[b] += n
        elif b < 0:
            closing[a] += n
        else:
            table[a, b] += n
    first[leaves.leaf[leaves.end]] += texts
    if first.sum():
        table[: am.LEAVES] += closing[: am.LEAVES, None] * (first / first.sum())
    table[am.START] += first
    return table


def _streams(pieces: np.ndarray, size: np.ndarray, code: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts end to end, each text with its end, and their number per text."""
    first = np.cumsum(size) - size
    per_text = np.diff(np.append(0, np.cumsum(size[code]))[np.append(0, np.cumsum(counts))]) + 1
    out = np.full(int(per_text.sum()), end, np.int64)
    out[ragged(np.cumsum(per_text) - per_text, per_text - 1)] = pieces[ragged(first[code], size[code])]
    return out, per_text


def training_windows(docs: DataFrame, share: float, leaves, model: str) -> DataFrame:
    """Runs of WINDOW + 1 leaves spread over the texts of a share of the training documents."""
    def run(batches):
        splitter, known = _splitter(model), received(leaves)
        for batch in pieces_of(batches, "text"):
            words, counts = split_words(text_array(batch["text"]), lower=True)
            coded = words.dictionary_encode()
            pieces, size = _word_pieces(splitter, coded.dictionary)
            ids, per_text = _streams(pieces, size, coded.indices.to_numpy(zero_copy_only=False), counts, known.end)
            leaf, first = known.leaf[ids], np.cumsum(per_text) - per_text
            rows = []
            for start, n in zip(first.tolist(), per_text.tolist()):
                stream = np.append(am.START, leaf[start: start + n])
                for k in range(min(SAMPLE_WINDOWS, len(stream) // (am.WINDOW + 1))):
                    at = (len(stream) - am.WINDOW - 1) * k // max(1, SAMPLE_WINDOWS - 1)
                    rows.append(stream[at: at + am.WINDOW + 1].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["leaves"])

    chosen = docs.where(F.col("learned") & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000))
    return chosen.select("text").mapInArrow(run, "leaves array<long>")


def refined(packed: DataFrame, leaves, start) -> tuple[am.Model, int]:
    """The model after one pass over all places of all training texts, and the number of these places.

    Each task steps on from the first weights; one row per weight and task meets
    in the average, so the driver gets one model, whatever the number of tasks.
    """
    def run(batches):
        known, learner = received(leaves), am.Refiner(received(start))
        for batch in batches:
            for k in range(batch.num_rows):
                learned = batch["learned"][k].values.to_numpy(zero_copy_only=False).astype(bool)
                counts = batch["n_words"][k].values.to_numpy()
                code = _unpacked(batch, k, "codes")[np.repeat(learned, counts)]
                counts = counts[learned]
                pieces, size = _unpacked(batch, k, "pieces"), _unpacked(batch, k, "sizes")
                for at, to, lo, hi in _slices(counts):
                    ids, per_text = _streams(pieces, size, code[lo:hi], counts[at:to], known.end)
                    learner.add(am.packed_windows(known.leaf[ids], per_text))
                pa.default_memory_pool().release_unused()
        if learner.seen:
            total = np.append(learner.flat(), 1.0) * learner.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "total"])

    parts = packed.select("learned", "n_words", "codes", "pieces", "sizes").mapInArrow(run, "slot int, total double")
    total = np.array([r["total"] for r in sorted(parts.groupBy("slot").agg(F.sum("total").alias("total")).collect())])  # one row per weight
    first = received(start)
    return (am.averaged(first, total[:-1] / total[-1]), int(total[-1])) if len(total) else (first, 0)


def _slices(counts: np.ndarray):
    """Runs of texts of about SLICE_TOKENS words, or one text: first and last text, first and last word."""
    ends, at = np.append(0, np.cumsum(counts)), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_TOKENS, "right")) - 1)
        yield at, to, ends[at], ends[to]
        at = to


def lm_scores(docs: DataFrame, learned, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, steps: int = STEPS) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) per row; ``learned`` is the condition on training rows."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    rows = docs.select(F.col(id_col).alias("doc_id"), learned.alias("learned"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks(rows, model).write.parquet(f"{folder}/blocks")
    packed = spark.read.parquet(f"{folder}/blocks")
    words = packed.select("block", F.posexplode(F.arrays_zip("words", "n"))).select("block", F.col("pos").alias("code"), F.col("col.words").alias("word"), F.col("col.n").alias("n"))
    words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    texts = packed.select(F.explode("learned").alias("l")).where("l").count()
    total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    distinct, tokens = total[0] + (texts > 0), (total[1] or 0) + texts

    follower_counts(counts, model).write.parquet(f"{folder}/followers")
    followers = spark.read.parquet(f"{folder}/followers")
    vocabulary = _splitter(model).get_piece_size()
    seen = {r["b"]: r["n"] for r in followers.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).collect()}  # at most one row per piece
    leaves = Leaves(seen, texts, vocabulary)
    table = spark.createDataFrame([(i, int(leaf)) for i, leaf in enumerate(leaves.leaf[:vocabulary])] + [(-1, -1)], "piece long, leaf long")
    by_leaf = followers.join(table.toDF("a", "la"), "a").join(table.toDF("b", "lb"), "b").groupBy("la", "lb").agg(F.sum("n").alias("n"))
    pairs = _pair_table([tuple(r) for r in by_leaf.collect()], leaves, texts)  # at most (leaves + 1)^2 rows
    shared_leaves = shipped(spark, leaves)
    sample = training_windows(rows, min(1.0, SAMPLE_DOCS / max(1, texts)), shared_leaves, model).collect()
    windows = np.array(sorted(r["leaves"] for r in sample), np.int64).reshape(-1, am.WINDOW + 1)
    shared_model = shipped(spark, refined(packed, shared_leaves, shipped(spark, am.train(windows, pairs, steps)))[0])

    known = words.select("block", "code", "word").join(counts, "word").groupBy("block").agg(F.collect_list(F.struct("code", "n")).alias("found"))
    joined = packed.select("block", "doc_id", "learned", "n_words", "codes", "pieces", "sizes").join(known, "block", "left").drop("block")
    floor = float(tokens + 0.5 * (distinct + 1))
    key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tables, fitted = received(shared_leaves), received(shared_model)
        for batch in batches:
            for k in range(batch.num_rows):
                counts_ = batch["n_words"][k].values.to_numpy()
                code, pieces, size = (_unpacked(batch, k, name) for name in ("codes", "pieces", "sizes"))
                found, seen_ = batch["found"][k].values, np.zeros(len(size), np.int64)
                if found is not None:  # words of the training texts
                    seen_[found.field("code").to_numpy()] = found.field("n").to_numpy()
                ends = np.append(0, np.cumsum(counts_))
                n_known = np.diff(np.append(0, np.cumsum(seen_[code] > 0))[ends]) + (texts > 0)
                base = np.diff(np.append(0.0, np.cumsum(np.log10((seen_ + 0.5) / floor)[code]))[ends]) + np.log10((texts + 0.5) / floor)
                score, n_pieces = np.zeros(len(counts_)), np.zeros(len(counts_), np.int64)
                for at, to, lo, hi in _slices(counts_):
                    ids, per_text = _streams(pieces, size, code[lo:hi], counts_[at:to], tables.end)
                    logs = am.score(fitted, tables.leaf[ids], per_text) + tables.inner[ids]
                    score[at:to] = np.add.reduceat(logs, np.cumsum(per_text) - per_text) / np.log(10)
                    n_pieces[at:to] = per_text
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][k].values, batch["learned"][k].values, pa.array(counts_ + 1), pa.array(n_known), pa.array(np.full(len(counts_), tokens)),
                     pa.array(base), pa.array(score), pa.array(n_pieces)],
                    ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_pieces"])
                pa.default_memory_pool().release_unused()

    return joined.mapInArrow(run, f"doc_id {key}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_pieces long")
