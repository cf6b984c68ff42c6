"""Readers for uploaded files: message tables, free CSV, JSON and text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.fixed_values import FILE_READERS
from riskloom.functions.text import strip
from riskloom.operators.ranking import row_index


def _with_place(df: DataFrame) -> DataFrame:
    """File, split start and order inside the split of every row."""
    return df.select(
        F.col("_metadata.file_path").alias("document_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "*")


def header_widths(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, width): number of fields in the first filled line of each CSV file."""
    lines = _with_place(spark.read.text(path)).where((F.col("block") == 0) & (F.length(F.trim("value")) > 0))
    first = lines.groupBy("document_id").agg(F.min_by("value", "seq").alias("line"))
    bare = F.regexp_replace("line", '"([^"]|"")*"', "")
    return first.select("document_id", (F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1).alias("width"))


def message_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(document_id, block, seq, message) from the first column of CSV files, each with its own header of one line.

    Rows with more filled fields than their file's header are skipped, as are
    blank messages.  The headers take a scan of their own.
    """
    widths = header_widths(spark, path)
    most = widths.agg(F.max("width")).first()[0] or 1
    names = [f"c{i}" for i in range(most + 1)]
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", "UTF-8")
    rows = _with_place(reader.schema(StructType([StructField(n, StringType()) for n in names])).csv(path))
    placed = rows.select(
        "document_id", "block", "seq", strip(F.col("c0")).alias("message"),
        F.greatest(F.lit(0), *[F.when(F.col(n).isNotNull(), i + 1) for i, n in enumerate(names)]).alias("filled"))
    kept = placed.where(F.length("message") > 0).join(widths, "document_id").where("filled <= width")
    return kept.select("document_id", "block", "seq", "message")


def numbered_messages(table: DataFrame, limit: int | None = None) -> DataFrame:
    """(document_id, pos, row, message): ``pos`` from 0 in file order, ``row`` counts the header as 1."""
    indexed = row_index(table, ["document_id"], "seq", F.col("block"), limit, name="pos")
    return indexed.select("document_id", "pos", (F.col("pos") + 2).alias("row"), "message")


def csv_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(document_id, pos, line): non-null text cells of the rows of each file (the first ``limit`` if given), joined by blanks."""
    typed = spark.read.option("header", True).option("inferSchema", True).option("mode", "PERMISSIVE").csv(path)
    names = [f"`{f.name}`" for f in typed.schema.fields if isinstance(f.dataType, StringType)]
    rows = _with_place(typed).select("document_id", "block", "seq", F.concat_ws(" ", *names).alias("line"))
    indexed = row_index(rows, ["document_id"], "seq", F.col("block"), limit, name="pos")
    return indexed.select("document_id", "pos", "line")


def joined_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """One text per document out of its lines, or its first ``limit``; for files whose text fits a row."""
    kept = lines if limit is None else lines.where(F.col("pos") < limit)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return kept.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("text"))


def _string_leaves(value, depth: int, max_depth: int | None) -> list[str]:
    if max_depth is not None and depth > max_depth:
        return []
    if isinstance(value, str):
        return [value]
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [leaf for child in children for leaf in _string_leaves(child, depth + 1, max_depth)]


def json_text(document: Column, max_depth: int | None = None) -> Column:
    """String leaves of a JSON text in document order, one per line; null for malformed JSON.

    Spark's variant type sorts object fields, which would lose the order, so
    batches of documents are walked in Python.
    """

    @F.pandas_udf("string")
    def flatten(batch: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return "\n".join(_string_leaves(json.loads(raw), 0, max_depth))
            except (TypeError, ValueError):
                return None

        return batch.map(one)

    return flatten(document)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) with undecodable bytes replaced."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("document_id"), F.make_valid_utf8("value").alias("text"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path).select("document_id", json_text(F.col("text")).alias("text"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, extension, size, reader, problem) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select(F.col("path").alias("document_id"), extension(F.col("path")).alias("extension"), F.col("length").alias("size")).select(
        "*", reader_of(F.col("extension")).alias("reader"), refusal(F.col("extension")).alias("problem"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def reader_of(ext: Column) -> Column:
    cells = [F.lit(x) for pair in FILE_READERS for x in pair]
    return F.create_map(*cells)[ext]


def refusal(ext: Column) -> Column:
    """Why a file is refused; null for an allowed extension."""
    return F.when(reader_of(ext).isNull(), F.concat(F.lit("unsupported file type ."), ext))
