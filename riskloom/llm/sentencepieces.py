"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file, which is a BPE model: its scores are
merge ranks and no log probabilities.  Log probabilities are estimated here
from all texts: the distinct chunks of the corpus are counted, and EM rounds
over this table sum the expected uses of each piece over all segmentations
(forward-backward), starting from the pieces' counts as substrings times their
lengths.  Counts are smoothed, so every piece keeps a finite score.

No piece holds a space after another character, so the best segmentation of a text is that of
its chunks (spaces and the characters up to the next space); each distinct
chunk of a batch is segmented once, all of them in lock step.  Characters
without a piece become byte pieces.  Decoding maps pieces to bytes, whitespace
markers to spaces, and drops the marker put before the text; it gives every
text back exactly, also one that holds the marker character itself, which is
written in byte pieces.

A character without a piece scores less than every piece.  Of equal scores the segmentation whose last piece starts first wins.

Defined results: a null text has null ids and decodes to null; an empty text
has no pieces; texts of any length are encoded whole; repeated rows agree;
other columns pass unchanged, unless the result has a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.double_array import DoubleArray, double_array, trie
from riskloom.llm.tables import received, shipped
from riskloom.llm.words import pieces_of, ragged, string_buffers, text_array
from riskloom.session import shared_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
SPACE = 32
SLICE_BYTES = 4 << 20  # text encoded at a time
ROUNDS = 4  # of EM after the first counts
SMOOTHING = 0.1  # added to the count of each piece
DIGITS = 6  # of log scores, so that the order of summing does not show


@dataclass(frozen=True)
class Pieces:
    """Vocabulary tables; ids are those of the model file."""

    trie: DoubleArray
    ids: np.ndarray  # id of each trie key
    scores: np.ndarray  # score by id: ranks as loaded from a BPE file, log probabilities once estimated
    unknown: float  # score of a character without a piece
    byte_ids: np.ndarray  # id of each byte value
    raw: np.ndarray  # bytes of all pieces, end to end
    offsets: np.ndarray  # where the bytes of each id begin


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keys, ids, texts = [], [], []
    byte_ids = np.full(256, -1, np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            key = piece.replace(MARKER, " ").encode()
            if b" " in key.lstrip(b" "):
                raise ValueError(f"piece {i} crosses a space")
            keys.append(key)
            ids.append(i)
            texts.append(key)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
    table, _ = double_array(*trie(keys))
    return Pieces(
        table, np.array(ids, np.int32), scores, float(scores[ids].min()) - UNKNOWN_PENALTY, byte_ids,
        np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def _walk(node: np.ndarray, at: np.ndarray, left: np.ndarray, room: np.ndarray, v: Pieces):
    """(rows of node, bytes, piece) of all pieces that start at these positions; piece is -2 for a character without one."""
    width = np.minimum(_char_bytes(room[at]), left)
    lone = np.ones(len(node), bool)  # no piece is exactly this character
    alive, state, depth = np.arange(len(node)), np.zeros(len(node), np.int64), 0
    while len(alive):
        state, ok = v.trie.step(state, room[at[alive] + depth])
        depth += 1
        alive, state = alive[ok], state[ok]
        key = v.trie.key[state]
        hit = key >= 0
        who = alive[hit]
        lone[who[width[who] == depth]] = False
        if len(who):
            yield who, depth, v.ids[key[hit]]
        more = left[alive] > depth
        alive, state = alive[more], state[more]
    for w in (1, 2, 3, 4):
        who = np.flatnonzero(lone & (width == w))
        if len(who):
            yield who, w, np.full(len(who), -2, np.int32)


def segment(raw: np.ndarray, offsets: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the best pieces of each chunk, end to end; their number and total score per chunk.

    Chunks go from the longest to the shortest, so those that still have a byte
    at step s are the first ones.  A step extends all best paths that reach it
    by every piece that starts there.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, size = offsets[:-1][order], lengths[order]
    room = np.append(raw, np.zeros(1, np.uint8))
    first = np.cumsum(size + 1) - (size + 1)  # the node before the first byte of each chunk
    best = np.full(int((size + 1).sum()), -np.inf)
    best[first] = 0.0
    back = np.zeros(len(best), np.int64)
    taken = np.full(len(best), -1, np.int32)
    scores = np.append(v.scores, [v.unknown, 0.0])  # -2 is a character without a piece
    active = len(size)
    for s in range(int(size[0]) if len(size) else 0):
        while active and size[active - 1] <= s:
            active -= 1
        reached = np.flatnonzero(best[first[:active] + s] > -np.inf)
        node, at, left = first[reached] + s, begin[reached] + s, size[reached] - s
        for who, depth, piece in _walk(node, at, left, room, v):
            _offer(best, back, taken, node[who], depth, best[node[who]] + scores[piece], piece)
    token = np.full(len(best), -1, np.int32)
    cursor = first + size
    score = best[cursor].copy()
    open_ = np.flatnonzero(size > 0)
    while len(open_):
        end = cursor[open_]
        start, piece = back[end], taken[end]
        known = piece >= 0
        token[start[known]] = piece[known]
        char = ragged(start[~known], end[~known] - start[~known])
        owner = np.repeat(open_[~known], end[~known] - start[~known])
        token[char] = v.byte_ids[room[begin[owner] + char - first[owner]]]
        cursor[open_] = start
        open_ = open_[start > first[open_]]
    chosen = token >= 0
    count = np.add.reduceat(chosen, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    flat, flat_first = token[chosen], np.cumsum(count) - count
    undo = np.empty(len(order), np.int64)
    undo[order] = np.arange(len(order))
    return flat[ragged(flat_first[undo], count[undo])], count[undo], score[undo]


def _offer(best, back, taken, node, width, score, piece) -> None:
    to = node + width
    better = score > best[to]
    to = to[better]
    best[to], back[to], taken[to] = score[better], node[better], piece[better]


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of non-empty texts end to end, where each starts, and where each text starts."""
    marked = pc.binary_join_element_wise(" ", texts, "")
    raw, offsets = string_buffers(marked)
    cut = (raw == SPACE) & (np.append(0, raw[:-1]) != SPACE)
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), starts, offsets


def chunk_counts(texts: DataFrame) -> DataFrame:
    """(chunk, n) of a table (text): each distinct chunk of all texts, and how often it occurs."""

    def run(batches):
        for batch in pieces_of(batches, "text", SLICE_BYTES):
            column = text_array(batch["text"])
            filled = column.filter(pc.greater(pc.binary_length(column), 0))
            if len(filled):
                found = _chunks(filled)[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["chunk", "n"])

    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = texts.mapInArrow(run, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n")).repartition(parts, "chunk")
    path = shared_dir(spark, "chunks")
    counts.write.parquet(path)
    return spark.read.parquet(path)


def substring_counts(raw: np.ndarray, offsets: np.ndarray, n: np.ndarray, v: Pieces) -> np.ndarray:
    """How often each piece occurs in the chunks, times its bytes, by id."""
    out = np.zeros(len(v.scores))
    room = np.append(raw, np.zeros(1, np.uint8))
    size = np.diff(offsets)
    begin = np.repeat(offsets[1:], size)
    times, every = np.repeat(n, size), np.arange(len(raw))
    for who, depth, piece in _walk(every, every, begin - every, room, v):
        known = piece >= 0
        np.add.at(out, piece[known], depth * times[who[known]].astype(float))
    return out


def expected_counts(raw: np.ndarray, offsets: np.ndarray, n: np.ndarray, v: Pieces) -> np.ndarray:
    """Expected uses of each piece, by id, over all segmentations of the chunks, each of which occurs n times.

    The sums to a chunk's end are made from its last byte back; the sums from
    its start, and with them the uses, from its first byte on.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, size, times = offsets[:-1][order], lengths[order], n[order].astype(float)
    room = np.append(raw, np.zeros(1, np.uint8))
    first = np.cumsum(size + 1) - (size + 1)
    scores = np.append(v.scores, [v.unknown, 0.0])  # -2 is a character without a piece
    until = np.full(int((size + 1).sum()), -np.inf)
    until[first + size] = 0.0
    since = np.full(len(until), -np.inf)
    since[first] = 0.0
    out = np.zeros(len(scores))
    steps = int(size[0]) if len(size) else 0
    for s in range(steps - 1, -1, -1):
        active = int(np.searchsorted(-size, -s, "left"))
        node, at, left = first[:active] + s, begin[:active] + s, size[:active] - s
        start = (room[at] & 0xC0) != 0x80
        node, at, left = node[start], at[start], left[start]
        for who, depth, piece in _walk(node, at, left, room, v):
            until[node[who]] = np.logaddexp(until[node[who]], scores[piece] + until[node[who] + depth])
    for s in range(steps):
        active = int(np.searchsorted(-size, -s, "left"))
        owner = np.flatnonzero(since[first[:active] + s] > -np.inf)
        node, at, left = first[owner] + s, begin[owner] + s, size[owner] - s
        for who, depth, piece in _walk(node, at, left, room, v):
            path = since[node[who]] + scores[piece]
            to = node[who] + depth
            since[to] = np.logaddexp(since[to], path)
            np.add.at(out, piece, np.exp(path + until[to] - until[first[owner[who]]]) * times[owner[who]])
    return out[:-2]


def with_counts(v: Pieces, counts: np.ndarray) -> Pieces:
    """The vocabulary scored by smoothed log shares of the counts."""
    own = counts[v.ids] + SMOOTHING
    logs = np.round(np.log(own / own.sum()), DIGITS)
    unknown = float(logs.min()) - UNKNOWN_PENALTY
    scores = np.full(len(v.scores), unknown)
    scores[v.ids] = logs
    return replace(v, scores=scores, unknown=unknown)


def _summed(chunks: DataFrame, shared, counts, v: Pieces) -> np.ndarray:
    """The counts of all slices of the chunk table, added up by id; one row per piece comes to the driver."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((v.scores, v.unknown))

    def run(batches):
        scores, unknown = sent.value
        pieces = replace(received(shared), scores=scores, unknown=unknown)
        total = np.zeros(len(scores))
        for batch in pieces_of(batches, "chunk", SLICE_BYTES // 2):
            total += counts(*string_buffers(batch["chunk"].cast(pa.binary())), batch["n"].to_numpy(), pieces)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "uses"])

    out = np.zeros(len(v.scores))
    for r in chunks.mapInArrow(run, "id int, uses double").groupBy("id").agg(F.sum("uses").alias("uses")).collect():
        out[r["id"]] = r["uses"]
    sent.destroy()
    return out


def estimated(docs: DataFrame, v: Pieces, text_col: str = "text", rounds: int = ROUNDS) -> Pieces:
    """The vocabulary with log probabilities of its pieces in all texts."""
    chunks = chunk_counts(docs.select(F.col(text_col).cast("string").alias("text")))
    shared = shipped(docs.sparkSession, v)
    v = with_counts(v, _summed(chunks, shared, substring_counts, v))
    for _ in range(rounds):
        v = with_counts(v, _summed(chunks, shared, expected_counts, v))
    shared.destroy()
    return v


def encode_texts(texts: pa.Array, v: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts end to end; number of pieces and log score of each text."""
    counts = np.zeros(len(texts), np.int64)
    scores = np.zeros(len(texts))
    filled = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if not len(filled):
        return np.zeros(0, np.int32), counts, scores
    chunks, starts, offsets = _chunks(texts.take(pa.array(filled)))
    chunks = chunks.dictionary_encode()
    code = chunks.indices.to_numpy(zero_copy_only=False)
    flat, size, score = segment(*string_buffers(chunks.dictionary), v)
    first = np.cumsum(size) - size
    per_text = np.searchsorted(starts, offsets[:-1])
    counts[filled] = np.add.reduceat(size[code], per_text)
    scores[filled] = np.add.reduceat(score[code], per_text)
    return flat[ragged(first[code], size[code])], counts, scores


def decode_ids(ids: np.ndarray, counts: np.ndarray, v: Pieces) -> pa.Array:
    """The texts that the ids of each text stand for."""
    size = v.offsets[ids + 1] - v.offsets[ids]
    raw = v.raw[ragged(v.offsets[ids], size)]
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
    keep = np.ones(len(raw), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False  # the marker before the text
    lengths = np.diff(ends) - (np.diff(ends) > 0)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])


RESULT = "ids array<int>, n_pieces long, n_byte_pieces long, log_score double, decoded string"


def sentencepieces(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The given columns and ids, n_pieces, n_byte_pieces, log_score and the decoded text, by the pieces' probabilities in these texts."""
    spark: SparkSession = docs.sparkSession
    shared = shipped(spark, estimated(docs, load_pieces(model), text_col))
    added = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches):
        v = received(shared)
        is_byte = np.zeros(len(v.scores), np.int64)
        is_byte[v.byte_ids] = 1
        for batch in pieces_of(batches, "text", SLICE_BYTES):
            column = batch["text"]
            gone = pc.is_null(column)
            ids, counts, scores = encode_texts(text_array(column), v)
            ends = np.append(0, np.cumsum(counts)).astype(np.int32)
            of_bytes = np.diff(np.append(0, np.cumsum(is_byte[ids]))[ends])
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(gone.to_numpy(zero_copy_only=False), False)), pa.array(ids))
            decoded = pc.if_else(gone, pa.scalar(None, pa.string()), decode_ids(ids, counts, v))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], lists, pa.array(counts), pa.array(of_bytes.astype(np.int64)), pa.array(scores), decoded], ["row", *added])

    kept = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("text"))
    made = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {RESULT}")
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)
