"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Test items are partitioned by their number of distinct five-word shingles, in
classes [2^c, 2^(c+1)).  An item's sketch is its smallest shingle digests
(bottom-k MinHash).  The sketch of a class is larger than the number of
shingles that a document may lack and still contain the wanted share of the
largest item of the class, so a document that contains enough of an item holds
at least one digest of its sketch: the search has no false negatives.  Long
documents are probed with every shingle.  Candidates are then verified by exact
containment of shingles as strings.

Defined results: words are lower-cased; texts with one to four words have one
shingle, the whole sequence; items without words, or with a null text, are not
searched; items with equal text count as one, under their smallest id (-1 if
all ids are null); a document with a null text holds nothing; rows equal in
doc_id and text share one result; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import word_array
from riskloom.operators.frames import explode_once
from riskloom.session import shared_dir

SHINGLE = 5
CONTAINMENT = 0.8


def _runs(words: Column, one) -> Column:
    """``one(i)`` for the start of each shingle of a word array; null if there is no word."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - F.lit(SHINGLE), F.lit(0)))
    return F.when(F.size(words) > 0, F.transform(starts, one))


def _digests(words: Column) -> Column:
    return _runs(words, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _shingles(words: Column) -> Column:
    return F.array_distinct(_runs(words, lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")))


def sketch_size(n: Column, share: float) -> Column:
    """One more than the shingles that may be missing from the largest item of the size class."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1) - 1
    return (F.floor((1 - share) * largest + 1e-9) + 1).cast("int")


def benchmark_items(benchmark: DataFrame, share: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, shingles, size, sketch) of every test item with words."""
    items = benchmark.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(
        F.coalesce(F.min(id_col).cast("long"), F.lit(-1).cast("long")).alias("item_id"))
    items = items.withColumn("words", word_array(F.lower("text"))).where(F.size("words") > 0)
    return items.select(
        F.xxhash64("text").alias("item"), "item_id",
        _shingles(F.col("words")).alias("shingles"), F.array_sort(F.array_distinct(_digests(F.col("words")))).alias("digests"),
    ).withColumn("size", F.size("shingles")).select(
        "item", "item_id", "shingles", "size", F.slice("digests", F.lit(1), sketch_size(F.col("size"), share)).alias("sketch"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, item_id, found, size) for each document and each item of which it contains ``share`` or more.

    Items and candidates are written to the shared folder first, so the planner
    knows their true size: it sends them to every executor only below its own
    broadcast limit and joins by shuffle beyond.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "decontaminate")
    benchmark_items(benchmark, share).write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    probes = items.select("item", F.explode("sketch").alias("h"))
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), word_array(F.lower(F.col(text_col))).alias("words"))
    hits = explode_once(narrow, ["id", "digest"], _digests(F.col("words")), "h").join(probes, "h")
    hits.groupBy("id", "digest", "item").agg(F.count(F.lit(1)).alias("n")).drop("n").write.parquet(f"{folder}/candidates")
    candidates = spark.read.parquet(f"{folder}/candidates")
    found = candidates.select(F.col("id").alias("c_id"), F.col("digest").alias("c_digest")).distinct()
    again = narrow.join(found, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest")), "left_semi")
    again = again.dropDuplicates(["id", "digest"])
    shingles = explode_once(again, ["id", "digest"], _shingles(F.col("words")), "shingle")
    parts = items.select("item", F.explode("shingles").alias("shingle"))
    counts = shingles.join(parts, "shingle").groupBy("id", "digest", "item").agg(F.count(F.lit(1)).alias("found"))
    return counts.join(items.select("item", "item_id", "size"), "item").where(F.col("found") >= F.ceil(F.lit(share) * F.col("size") - 1e-9)).select(
        "id", "digest", "item_id", "found", "size")


def _matched(docs: DataFrame, benchmark: DataFrame, share: float, id_col: str, text_col: str) -> DataFrame:
    per_doc = contaminated(docs, benchmark, share, id_col, text_col).groupBy("id", "digest").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("found") / F.col("size")).alias("containment"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_digest"))
    return rows.join(per_doc, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest")), "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no test item."""
    clean = _matched(docs, benchmark, share, id_col, text_col).where(F.col("items").isNull())
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def contamination_report(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the items it contains (comma-joined ids, ascending), their number, and the highest share found."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    per_doc = contaminated(narrow, benchmark, share).groupBy("id", "digest").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("found") / F.col("size")).alias("containment"))
    rows = narrow.select("doc_id", F.xxhash64("text").alias("row_digest"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest")), "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
        F.round(F.coalesce("containment", F.lit(0.0)), 6).alias("containment"),
        F.col("items").isNotNull().alias("contaminated"),
    )
