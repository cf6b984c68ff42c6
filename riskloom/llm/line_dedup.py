"""Line de-duplication by overlapping three-line windows, in DataFrame operations only.

Every run of three consecutive lines of a text is hashed.  A window that occurs
more than once over the whole corpus is kept where it occurs first, in order of
(doc_id, digest of the text, line number), and its three lines are removed at
every later place.  Covered positions of overlapping windows merge, so a
repeated passage of any length of three lines or more goes as a whole.

Defined results: a null text counts as empty and stays null; texts of fewer
than three lines never change; rows that are equal in doc_id and text share one
decision, so repeated rows do not empty each other; a null doc_id sorts first;
a text that loses every line becomes empty; further columns pass unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.frames import explode_once

WINDOW = 3


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _window_hashes(lines: Column) -> Column:
    """Position and 128-bit digest of every run of three lines."""
    def digest(i: Column) -> Column:
        run = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit("line window"), *run[::-1]).alias("h2"))

    starts = F.sequence(F.lit(0), F.size(lines) - F.lit(WINDOW))
    return F.when(F.size(lines) >= WINDOW, F.transform(starts, digest))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, starts): first lines of the windows of a text that occurred before."""
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text_lines(text).alias("lines"))
    places = explode_once(narrow, ["id", "digest"], _window_hashes(F.col("lines")), "w").select("id", "digest", "w.*")
    place = F.struct("id", "digest", "pos")
    firsts = places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = places.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "digest").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): the given row as a struct and its text without repeated passages."""
    later = later_windows(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.col(text_col)).alias("row_digest"))
    joined = rows.join(later, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest")), "left")
    text = F.col("row").getField(text_col)
    lines = text_lines(text)
    covered = F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)])))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered))
    rest = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    whole = F.col("starts").isNull()
    return joined.select(
        "row",
        F.when(whole, text).otherwise(rest).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_removed"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages removed; all other columns as they were."""
    done = dedup_lines(docs, id_col, text_col)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
