"""Feed entries from landed XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import strip
from riskloom.functions.urls import feed_item_id
from riskloom.operators.ranking import row_index

ENTRY = "title string, description string, summary string, link string, pubDate string, updated string, guid string, id string, author string"


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """(feed, block, seq, entry) from XML files; each file is one feed."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(ENTRY).load(path)
    entry = F.struct(*[c.split()[0] for c in ENTRY.split(", ")])
    return rows.select(
        F.col("_metadata.file_path").alias("feed"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), entry.alias("entry"))


def parse_entry(xml: Column) -> Column:
    return F.from_xml(xml, ENTRY)


def feed_items(entries: DataFrame, source_type: str, block: Column, order: str = "seq", limit: int | None = None) -> DataFrame:
    """Items of feed entries (feed, entry): fallbacks for missing fields, text, id.

    Every entry becomes an item; with ``limit`` only the first ones of each feed
    (a display may take ``FEED_LIMITS[source_type]``).
    """
    kept = row_index(entries, ["feed"], order, block, limit, name="entry_no")
    e = F.col("entry")

    def present(value: Column) -> Column:
        return F.when(F.length(value) > 0, value)

    empty = F.lit("")
    title = F.coalesce(present(e["title"]), empty)
    summary = F.coalesce(present(e["description"]), present(e["summary"]), empty)
    link = F.coalesce(present(e["link"]), F.col("feed"))
    published = F.coalesce(present(e["pubDate"]), e["updated"])
    guid = F.coalesce(present(e["guid"]), present(e["id"]), link, title)
    kind = F.lit(source_type)
    return kept.select(
        "feed", "entry_no", feed_item_id(kind, guid, title, published).alias("external_id"), kind.alias("source_type"),
        F.col("feed").alias("source"), title.alias("title"), strip(F.concat(title, F.lit("\n\n"), summary)).alias("text"),
        link.alias("url"), e["author"].alias("author"), published.alias("published"))
