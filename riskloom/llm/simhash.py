"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is set if more than half of the XXH64 digests of a text's
four-word shingles (repeats included) have it set.  Fingerprints that differ in
at most four bits are linked, and linked texts form one group.

The 64 bits are cut into three segments.  Two fingerprints within four bits
agree in one segment up to one bit, so each fingerprint looks up, per segment,
its own value and its values with one bit set more (the partner with the lower
bit finds the other); fetched pairs are verified by their whole distance.

Dense groups do not expand into all their pairs.  First each table bucket links
its members to the smallest one, where within the distance, and these links are
merged into preliminary groups.  The lookups then fetch only pairs of different
groups, so rows grow with the groups and not with the square of their size.
Copies share a fingerprint and enter once.

Defined results: null and blank texts have fingerprint zero and are linked like
any other; fewer than four words make one shingle; a null doc_id takes part and
counts as the largest id; rows with equal doc_id each get their own row in the
result; a table without rows gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.words import ragged, split_words, string_buffers, text_array
from riskloom.session import shared_dir

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width; three segments leave one difference at most in one of them
SLICE = 500


def _shingle_digests(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a batch in order, and the number of shingles of each text."""
    words, counts = split_words(texts, lower=True)
    raw, offsets = string_buffers(words)
    lengths = np.diff(offsets)
    spaced = np.full(len(raw) + len(words), 32, np.uint8)
    starts = offsets[:-1] + np.arange(len(words))
    spaced[ragged(starts, lengths)] = raw
    ends = starts + lengths
    made = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    begin = ragged(first, made)
    last = np.minimum(begin + shingle - 1, np.repeat(first + counts - 1, made))
    view, digest = memoryview(spaced.tobytes()), xxhash.xxh64_intdigest
    hashes = (digest(view[s:e], seed) for s, e in zip(starts[begin].tolist(), ends[last].tolist()))
    return np.fromiter(hashes, np.uint64, len(begin)), made


def _fingerprints(hashes: np.ndarray, made: np.ndarray) -> np.ndarray:
    out = np.zeros(len(made), np.uint64)
    full = made > 0
    if full.any():
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(made) - made)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > made[full][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, digest: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed 64-bit number; if asked for, with Spark's digest of the text."""
    text = F.col(text_col).cast("string")
    taken = [F.col(id_col).alias("doc_id"), *([F.xxhash64(text).alias("digest")] if digest else [])]
    names = ["doc_id", *(["digest"] if digest else [])]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fp = _fingerprints(*_shingle_digests(text_array(part["text"]), shingle, seed))
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.select(*taken, text.alias("text")).mapInArrow(run, f"doc_id {id_type}, {'digest long, ' if digest else ''}fp long")


def _segment(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _ball(key: Column, width: int) -> Column:
    """The key itself and the keys with one more bit set."""
    flips = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), lambda m: key.bitwiseAND(m) == 0)
    return F.concat(F.array(key), F.transform(flips, lambda m: key.bitwiseOR(m)))


def _lookups(seg: int, key: Column, width: int) -> Column:
    return F.transform(_ball(key, width), lambda k: F.struct(F.lit(seg).alias("seg"), k.alias("key")))


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def linked_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for the distinct fingerprints (fp) that have a link, under the smallest fingerprint they reach."""
    spark = prints.sparkSession
    keys = F.array(*[F.struct(F.lit(n).alias("seg"), _segment(F.col("fp"), at, width).alias("key")) for n, (at, width) in enumerate(SEGMENTS)])
    table = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.seg", "k.key")
    centre = table.groupBy("seg", "key").agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = table.join(centre, ["seg", "key"]).where((F.col("fp") != F.col("centre")) & _near("fp", "centre", distance))
    first = components(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    path = shared_dir(spark, "simhash")
    grouped = prints.join(first, prints["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("grp"))
    grouped.write.parquet(path)
    grouped = spark.read.parquet(path)
    index = grouped.select("fp", "grp", F.explode(keys).alias("k")).select(F.col("fp").alias("fp_b"), F.col("grp").alias("grp_b"), "k.seg", "k.key")
    balls = F.flatten(F.array(*[_lookups(n, _segment(F.col("fp"), at, width), width) for n, (at, width) in enumerate(SEGMENTS)]))
    probes = grouped.select("fp", "grp", F.explode(balls).alias("k")).select("fp", "grp", "k.seg", "k.key")
    on = (probes["seg"] == index["seg"]) & (probes["key"] == index["key"]) & (F.col("grp") != F.col("grp_b")) & _near("fp", "fp_b", distance)
    more = probes.join(index, on).select(F.col("grp").alias("a"), F.col("grp_b").alias("b")).distinct()
    second = components(more)
    return grouped.join(second, grouped["grp"] == second["node"], "left").select("fp", F.coalesce("root", "grp").alias("root"))


def _prints(docs: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    path = shared_dir(docs.sparkSession, "fingerprints")
    fingerprints(docs, id_col, text_col, digest=digest).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row: the component is the smallest doc_id reachable over links."""
    prints = _prints(docs, id_col, text_col)
    per_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = linked_fingerprints(per_fp.select("fp"))
    mapped = per_fp.join(roots, "fp")
    lowest = mapped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = mapped.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def smallest_rows(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` per root of ``groups`` (doc_id, digest, root): that with the smallest id, null last, then the smallest digest.

    Rows equal in id and text are interchangeable: one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("digest"))
    stay = groups.groupBy("root").agg(F.min(rank).alias("stay")).select("stay.doc_id", F.col("stay.digest").alias("stay_digest"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))
    kept = rows.join(stay, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("stay_digest")), "left_semi")
    one = kept.groupBy("row_id", "digest").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, once.

    Groups that share an id, or have null ids only, stay apart: each keeps one
    row.  Rows of a group that share its smallest id are told apart by the
    digest of their text.
    """
    prints = _prints(docs, id_col, text_col, digest=True)
    per_fp = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("digest"))).alias("low"))
    mapped = per_fp.join(linked_fingerprints(per_fp.select("fp")), "fp")
    return smallest_rows(docs, mapped.select("low.doc_id", "low.digest", "root"), id_col, text_col)
