"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of ``least`` bytes that also starts elsewhere is
removed.  Strings are judged on the input; matches stay inside a document.

1. Each string of ``least`` bytes is filed under its anchor: its core of CORE
   bytes with the smallest digest (leftmost of equal ones).  Equal strings have
   equal anchors at equal offsets, so a string can only repeat under a repeated
   anchor.  Neighbouring strings with one anchor make one context.
2. Anchors that occur once drop out.  Where all contexts of an anchor are equal,
   all their strings repeat.
3. Different contexts of an anchor meet in a bucket, each written once as its
   left bytes, a core mark with the number of the anchor, and its right bytes.
   The suffixes of the bucket are sorted and transformed; intervals of common
   prefixes then grow backwards, by one symbol a level, breadth first.  The
   level at which a boundary between neighbouring suffixes is first met is the
   length of their common prefix.  Levels stop at the length of a string; a
   boundary not met by then joins two equal strings.
4. Anchors with more than HOT different contexts are not put into one bucket.
   Their strings are compared by digest in a grouped count, which combines
   before it shuffles; the result is the same.

Defined results: a null text counts as empty; a text shorter than ``least``
never changes; the copies of a repeated row are elsewhere for each other, so
long ones go entirely; positions are bytes of the UTF-8 form, and what is left
may cut characters, so it is returned as binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import pieces_of, ragged, string_buffers, text_array
from riskloom.session import shared_dir

LEAST = 400
CORE = 256
HOT = 2000
FREQUENT = 1000  # a key of more than one in so many rows is joined where its rows are; there are fewer such keys than this
BUCKET_SYMBOLS = 1 << 20
SEGMENT = 1 << 19  # string starts handled at a time
POSITION_BITS = 20
RADIX = 0x9E3779B97F4A7C15
WORD = 1 << 64
COUNT_BYTES = 2  # digits of an anchor's number in its bucket


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the radix and of its inverse modulo 2^64."""

    def __init__(self, size: int):
        up, down = np.full(size, RADIX, np.uint64), np.full(size, pow(RADIX, -1, WORD), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)


def _contexts(raw: np.ndarray, least: int, powers: _Powers):
    """Anchor position, first and last string start, anchor digest and context digest of each context of a text."""
    width = least - CORE + 1
    for at in range(0, len(raw) - least + 1, SEGMENT):
        part = raw[at: at + SEGMENT + least - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=sums[1:])
        core = _mixed((sums[CORE:] - sums[:-CORE]) * powers.down[: n - CORE + 1])
        mark = np.uint64((1 << POSITION_BITS) - 1)
        packed = np.full(-(-len(core) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        packed[: len(core)] = (core & ~mark) | np.arange(len(core), dtype=np.uint64)
        rows = packed.reshape(-1, width)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(rows, axis=1).ravel()
        strings = n - least + 1
        low = np.minimum(ahead[:strings], behind[width - 1: width - 1 + strings])
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        last = np.append(first[1:], strings) - 1
        anchor = (low[first] & mark).astype(np.int64)
        span = (sums[last + least] - sums[first]) * powers.down[first]
        shape = ((anchor - first) * width + (last - first)).astype(np.uint64)
        context = _mixed(span ^ (shape * np.uint64(0xD6E8FEB86659FD93)))
        yield at + anchor, at + first, at + last, core[anchor].view(np.int64), context.view(np.int64)


def _texts(batch: pa.RecordBatch):
    raw, offsets = string_buffers(text_array(batch["text"]))
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def anchors(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, digest, pos, first, last, anchor, context) for the rows (doc_id, digest, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        powers = _Powers(SEGMENT + least)
        for batch in pieces_of(batches, "text"):
            row, parts = [], []
            for number, raw in enumerate(_texts(batch)):
                for found in _contexts(raw, least, powers) if len(raw) >= least else ():
                    row.append(np.full(len(found[0]), number))
                    parts.append(found)
            if parts:
                who = pa.array(np.concatenate(row))
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(who), batch["digest"].take(who), *columns], ["doc_id", "digest", "pos", "first", "last", "anchor", "context"])

    return docs.mapInArrow(run, f"doc_id {key}, digest long, pos long, first long, last long, anchor long, context long")


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of a symbol sequence in the order of their first ``length`` symbols or more."""
    n = len(symbols)
    rank, have = symbols.astype(np.int64) + 1, 1
    order = None
    while order is None or (have < length and rank[order[-1]] < n):
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:]
        both = rank * (int(rank.max()) + 2) + after
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
        have *= 2
    return order


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` symbols from each place also starts at another place.

    ``common[j]`` is the level at which the boundary before the j-th suffix was
    met; intervals that meet no new boundary end there, so each boundary costs
    one interval.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, bool)
    order = suffix_order(symbols, length)
    before = symbols[order - 1]  # the transform; the text is taken as a circle
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    common = np.full(n + 1, -1, np.int64)
    common[0] = common[n] = 0
    left, right = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(1, length + 1):
        inside = ragged(left, right - left)
        group = np.repeat(np.arange(len(left)), right - left) * (int(symbols.max()) + 1) + before[inside]
        by = np.argsort(group, kind="stable")
        group, inside = group[by], inside[by]
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        old = np.append(new[1:], len(group)) - 1
        left, right = step[inside[new]], step[inside[old]] + 1
        fresh = common[right] < 0
        common[right[fresh]] = level - 1
        left, right = left[fresh], right[fresh]
        if level == 1:  # the interval that ends the order meets no boundary but is needed for its extensions
            left, right = step[inside[new]], step[inside[old]] + 1
        if not len(left):
            break
    equal = common < 0
    out = np.zeros(n, bool)
    out[order] = equal[:-1] | equal[1:]
    return out


def _bucket_strings(lefts: list[bytes], rights: list[bytes], number: np.ndarray, width: int) -> list[np.ndarray]:
    """Offsets (bytes left of the anchor) of the strings of each context that occur in another place of the bucket.

    A string of ``width`` - 1 bytes around a core becomes as many symbols with
    the core mark and the digits of the anchor's number in between.
    """
    core, end = 256, 257
    parts, start, at = [], [], 0
    for left, right, k in zip(lefts, rights, number.tolist()):
        digits = [(k >> (8 * d)) & 255 for d in range(COUNT_BYTES)]
        one = np.concatenate([np.frombuffer(left, np.uint8).astype(np.int32), [core, *digits], np.frombuffer(right, np.uint8).astype(np.int32), [end]])
        start.append(at + len(left))
        parts.append(one)
        at += len(one)
    flags = repeated_starts(np.concatenate(parts).astype(np.int32), width + COUNT_BYTES)
    out = []
    for left, right, mid in zip(lefts, rights, start):
        least_left = width - 1 - len(right)
        offsets = np.arange(least_left, len(left) + 1)
        out.append(offsets[flags[mid - offsets]])
    return out


def _runs(offsets: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte ranges, relative to the anchor, covered by the strings that start ``offsets`` bytes before it."""
    if not len(offsets):
        return []
    offsets = np.sort(offsets)
    cut = np.flatnonzero(np.diff(offsets) > 1)
    lows, highs = offsets[np.append(0, cut + 1)], offsets[np.append(cut, len(offsets) - 1)]
    return [(-int(h), least - int(a)) for a, h in zip(lows, highs)]


def _by_transform(contexts: DataFrame, buckets: int, least: int) -> DataFrame:
    """(anchor, context, start, end) for the contexts (anchor, context, left, right), a bucket at a time."""
    width = least - CORE + 1

    def run(table: pa.Table) -> pa.Table:
        keys, number = np.unique(table["anchor"].to_numpy(), return_inverse=True)
        found = []
        for at in range(0, len(keys), 1 << (8 * COUNT_BYTES)):  # numbers of a part fit their digits
            rows = np.flatnonzero((number >= at) & (number < at + (1 << (8 * COUNT_BYTES))))
            part = table.take(pa.array(rows))
            strings = _bucket_strings(part["left"].to_pylist(), part["right"].to_pylist(), number[rows] - at, width)
            for row, offsets in zip(rows.tolist(), strings):
                found += [(row, s, e) for s, e in _runs(offsets, least)]
        where = pa.array([f[0] for f in found], pa.int64())
        return pa.table({
            "anchor": table["anchor"].take(where), "context": table["context"].take(where),
            "start": pa.array([f[1] for f in found], pa.int64()), "end": pa.array([f[2] for f in found], pa.int64())})

    dealt = contexts.withColumn("bucket", F.pmod("anchor", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "anchor long, context long, start long, end long")


def _by_digest(contexts: DataFrame, least: int) -> DataFrame:
    """The same for anchors with very many contexts: strings are counted by digest."""
    width = least - CORE + 1

    def run(batches):
        for batch in batches:
            row, low, high, offset = [], [], [], []
            for number, (left, right) in enumerate(zip(batch["left"].to_pylist(), batch["right"].to_pylist())):
                for n in range(width - 1 - len(right), len(left) + 1):
                    digest = xxhash.xxh3_128_intdigest(left[len(left) - n:] + b"|" + right[: width - 1 - n], n)
                    row.append(number)
                    offset.append(n)
                    low.append((digest & (WORD - 1)) - (WORD >> 1))
                    high.append((digest >> 64) - (WORD >> 1))
            who = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["anchor"].take(who), batch["context"].take(who), pa.array(offset, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["anchor", "context", "offset", "d1", "d2"])

    strings = contexts.select("anchor", "context", "left", "right").mapInArrow(run, "anchor long, context long, offset long, d1 long, d2 long")
    common = strings.groupBy("anchor", "d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return strings.join(common, ["anchor", "d1", "d2"]).select("anchor", "context", (-F.col("offset")).alias("start"), (F.lit(least) - F.col("offset")).alias("end"))


def _joined(rows: DataFrame, found: DataFrame, keys: list[str], frequent: DataFrame) -> DataFrame:
    """Inner join by keys.  The rows of the few frequent keys are not dealt by key, so a large group of copies does not meet in one task."""
    few = F.broadcast(frequent)
    dealt = rows.join(few, keys, "left_anti").join(found, keys)
    return dealt.unionByName(rows.join(F.broadcast(found.join(few, keys, "left_semi")), keys))


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, digest, spans): byte ranges to remove, as found, for the rows (doc_id, digest, text) that have any."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "suffix")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    width = least - CORE + 1
    every = stored(anchors(docs, least), "anchors")
    groups = every.groupBy("anchor").agg(F.min("context").alias("a"), F.max("context").alias("b"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("varied"), "n"), "groups")
    most = every.count() // FREQUENT
    hits = stored(_joined(every, groups.drop("n"), ["anchor"], groups.where(F.col("n") > most).select("anchor")), "hits")
    whole = hits.where(~F.col("varied")).select("doc_id", "digest", F.col("first").alias("start"), (F.col("last") + least).alias("end"))

    varied = hits.where("varied")
    place = F.struct("doc_id", "digest", "pos", "first", "last")
    shown = stored(varied.groupBy("anchor", "context").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")), "contexts")
    often = shown.where("n > 1").select("anchor", "context", (F.col("place.first") - F.col("place.pos")).alias("start"), (F.col("place.last") + least - F.col("place.pos")).alias("end"))
    wanted = shown.select(F.col("place.doc_id").alias("id"), F.col("place.digest").alias("d"), F.struct("anchor", "context", "place.pos", "place.first", "place.last").alias("c"))
    per_doc = wanted.groupBy("id", "d").agg(F.collect_list("c").alias("wanted"))
    sources = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    cut = sources.select(F.encode("text", "UTF-8").alias("raw"), F.explode("wanted").alias("c")).select(
        "c.anchor", "c.context",
        F.substring("raw", F.col("c.first") + 1, F.col("c.pos") - F.col("c.first")).alias("left"),
        F.substring("raw", F.col("c.pos") + CORE + 1, F.col("c.last") + least - F.col("c.pos") - CORE).alias("right"))
    cut = stored(cut.dropDuplicates(["anchor", "context"]), "cut")
    counts = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("left") + F.length("right") + COUNT_BYTES + 2).alias("symbols"))
    total = counts.where(F.col("n") <= hot).agg(F.sum("symbols")).first()[0] or 0
    crowded = counts.where(F.col("n") > hot).select("anchor")
    usual = cut.join(crowded, "anchor", "left_anti")
    spread = stored(_by_transform(usual, total // BUCKET_SYMBOLS + 1, least).unionByName(_by_digest(cut.join(crowded, "anchor", "left_semi"), least)).unionByName(often), "spread")
    partly = _joined(varied, spread, ["anchor", "context"], shown.where(F.col("n") > most).select("anchor", "context")).select("doc_id", "digest", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))
    spans = whole.unionByName(partly)
    return spans.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _kept(raw: np.ndarray, spans: list[dict]) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return raw[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): the given row as a struct, the bytes left of its text, and counts."""
    if least <= CORE:
        raise ValueError(f"strings must be longer than the core of {CORE} bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    spans = repeated_spans(narrow, least, hot).withColumnsRenamed({"doc_id": "id", "digest": "d"})
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    packed = joined.select("row", "text", "spans")

    def run(batches):
        for batch in pieces_of(batches, "text"):
            kept, counts = [], []
            for raw, own in zip(_texts(batch), batch["spans"].to_pylist()):
                rest, n = _kept(raw, own) if own else (raw.tobytes(), 0)
                kept.append(rest)
                counts.append((len(raw), len(raw) - len(rest), n))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(kept, pa.binary()), *columns], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")
