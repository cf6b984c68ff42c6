"""Token counts by a linear longest-match automaton.

Greedy word-piece length of a word: the longest word-initial piece, then the
longest continuation pieces.  The automaton is the trie of both vocabularies
with failure links; a link carries the number of pieces that are certain once
it is taken (Song et al., 2021).  A word is read once, byte by byte, and only
counted: no piece is built.  The distinct words of a batch run in lock step.

Defined results: a word that cannot be composed counts as one unknown token; a
null or blank text has no words and no tokens; words of any length are read
whole; repeated rows agree; other columns pass unchanged, unless the result has
a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.double_array import DoubleArray, double_array, trie
from riskloom.llm.sentencepieces import MARKER, MODEL
from riskloom.llm.tables import received, shipped
from riskloom.llm.words import pieces_of, split_words, string_buffers, text_array

INSIDE = b"\xff"  # leads to the continuation pieces; no UTF-8 text holds it


@dataclass(frozen=True)
class Automaton:
    trie: DoubleArray
    fail: np.ndarray  # state after a failure, -1 if the word cannot be composed
    popped: np.ndarray  # pieces that the failure completes
    inside: int  # state in which every earlier byte belongs to a completed piece


def word_pieces(path: str = MODEL) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuation pieces of a public model file.

    Initial are the pieces with a whitespace marker, and single characters.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, inside = set(), set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        word = piece.lstrip(MARKER)
        if word and len(piece) - len(word) == 1:
            initial.add(word.encode())
        if word and word == piece:
            inside.add(word.encode())
            if len(word) == 1:
                initial.add(word.encode())
    return sorted(initial), sorted(inside)


def build_automaton(initial: list[bytes], inside: list[bytes]) -> Automaton:
    children, ends = trie([*initial, *(INSIDE + w for w in inside)])
    table, state = double_array(children, ends)
    fail, popped = [-1] * len(children), [0] * len(children)
    start = children[0].get(INSIDE[0], -1)
    queue = [0] + ([start] if start >= 0 else [])
    for node in queue:
        for byte, kid in children[node].items():
            if node == 0 and kid == start:
                continue
            queue.append(kid)
            if ends[kid] >= 0:
                fail[kid], popped[kid] = start, 1
                continue
            link, count = fail[node], popped[node]
            while link >= 0 and byte not in children[link]:
                count += popped[link]
                link = fail[link]
            if link >= 0:
                fail[kid], popped[kid] = children[link][byte], count
    size = len(table.base)
    fails, pops = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    fails[state] = [state[f] if f >= 0 else -1 for f in fail]
    pops[state] = popped
    return Automaton(table, fails, pops, int(state[start]) if start >= 0 else -1)


def count_pieces(raw: np.ndarray, offsets: np.ndarray, a: Automaton) -> np.ndarray:
    """Number of pieces of each word, 0 for a word that cannot be composed."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    begin, length = offsets[:-1][order], size[order]
    state = np.zeros(len(order), np.int64)
    total = np.zeros(len(order), np.int64)
    active = len(order)
    for s in range(int(length[0]) if len(length) else 0):
        while active and length[active - 1] <= s:
            active -= 1
        todo = np.flatnonzero(state[:active] >= 0)
        while len(todo):
            to, ok = a.trie.step(state[todo], raw[begin[todo] + s])
            state[todo[ok]] = to[ok]
            todo = todo[~ok]
            total[todo] += a.popped[state[todo]]
            state[todo] = a.fail[state[todo]]
            todo = todo[state[todo] >= 0]
    todo = np.flatnonzero((state >= 0) & (state != a.inside))
    while len(todo):
        total[todo] += a.popped[state[todo]]
        state[todo] = a.fail[state[todo]]
        todo = todo[(state[todo] >= 0) & (state[todo] != a.inside)]
    total[state < 0] = 0
    out = np.empty(len(order), np.int64)
    out[order] = total
    return out


RESULT = "n_words long, n_tokens long, n_unknown long"


def token_counts(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The given columns and n_words, n_tokens and n_unknown of each text."""
    shared = shipped(docs.sparkSession, build_automaton(*word_pieces(model)))
    added = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches):
        automaton = received(shared)
        for batch in pieces_of(batches, "text"):
            words, counts = split_words(text_array(batch["text"]), lower=False)
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            pieces = count_pieces(*string_buffers(coded.dictionary), automaton)
            ends = np.append(0, np.cumsum(counts))
            tokens = np.append(0, np.cumsum(np.maximum(pieces, 1)[code]))[ends]
            unknown = np.append(0, np.cumsum((pieces == 0)[code]))[ends]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(counts), pa.array(np.diff(tokens)), pa.array(np.diff(unknown))], ["row", *added])

    kept = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("text"))
    made = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {RESULT}")
    return made.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)
