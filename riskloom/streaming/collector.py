"""Incremental collection: landed items are de-duplicated, scored, stored and turned into alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskloom.fixed_values import ALERT_THRESHOLD
from riskloom.operators.monitor import ITEM_KEY, active, alert_event, new_items, of_sources, raise_alerts, touch, with_text
from riskloom.sources.sinks import read_store, write_batch

POLL_INTERVAL = "300 seconds"


def landed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def start(writer, once: bool = True, interval: str = POLL_INTERVAL) -> StreamingQuery:
    """Drain what has landed and stop, or poll for ever."""
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


class Collector:
    """Stores below one folder: ``items``, ``alerts``, ``polls`` and ``quarantine``, each by batch.

    Only active sources are polled: what landed for others is left out, except
    that unreadable rows of any source are set aside.  A batch writes only its
    own folders and compares itself with earlier batches, so repeating a batch
    after a failure gives the same stores.
    """

    def __init__(self, spark: SparkSession, folder: str, sources: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = ALERT_THRESHOLD):
        self.spark = spark
        self.folder = folder
        self.sources = sources
        self.score = score
        self.threshold = threshold

    def store(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "_corrupt" in batch.columns:
            broken = F.col("_corrupt").isNotNull()
            write_batch(batch.where(broken).select("source_id", "_corrupt"), self.store("quarantine"), batch_id)
        batch = of_sources(batch, active(self.sources))
        valid = batch
        if "_corrupt" in batch.columns:
            valid = batch.where(~broken).drop("_corrupt")
        keys = StructType([f for f in batch.schema.fields if f.name in ITEM_KEY])
        stored = read_store(spark, self.store("items"), keys.add("batch_id", "integer"), before=batch_id)
        fresh = self.score(new_items(valid, stored))
        write_batch(fresh, self.store("items"), batch_id)
        written = spark.read.schema(fresh.schema).parquet(f"{self.store('items')}/batch_id={batch_id}")
        write_batch(alert_event(raise_alerts(written, self.sources, self.threshold)), self.store("alerts"), batch_id)
        write_batch(self._poll(batch, written), self.store("polls"), batch_id)

    def _poll(self, batch: DataFrame, written: DataFrame) -> DataFrame:
        """Per source: rows fetched, rows stored, whether some could not be read, and the time."""
        error = F.lit(None).cast("string")
        if "_corrupt" in batch.columns:
            error = F.when(F.count("_corrupt") > 0, F.concat(F.count("_corrupt").cast("string"), F.lit(" unreadable rows")))
        fetched = batch.groupBy("source_id").agg(F.count("*").alias("fetched"), error.alias("error"))
        fresh = written.groupBy("source_id").agg(F.count("*").alias("new"))
        counts = fetched.join(fresh, "source_id", "left").na.fill(0, ["new"])
        return counts.withColumn("checked_at", F.current_timestamp().cast("timestamp_ntz"))

    def checked_sources(self) -> DataFrame:
        """All sources, ``last_checked`` set to the newest poll of each."""
        schema = f"source_id {self.sources.schema['source_id'].dataType.simpleString()}, checked_at timestamp_ntz"
        return touch(self.sources, read_store(self.spark, self.store("polls"), schema))

    def run(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return start(stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint), once)


def deduplicated(stream: DataFrame) -> DataFrame:
    """First row per item key for ever; the keys seen are kept as state."""
    return with_text(stream).dropDuplicates(ITEM_KEY)


def deduplicated_within(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """First row per item key among rows at most ``delay`` apart; state is dropped behind the watermark."""
    return with_text(stream).withWatermark(time, delay).dropDuplicatesWithinWatermark(ITEM_KEY)


def to_folder(stream: DataFrame, folder: str, checkpoint: str, by: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Append rows to Parquet, optionally one folder per value (for instance per alert owner)."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return start(writer.partitionBy(*by) if by else writer, once)


def to_snapshot(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the complete result of an aggregation; every batch writes its own folder and the newest one counts."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/snapshot={batch_id:012d}")

    return start(stream.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", checkpoint), once)


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of the last batch."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    last = rows.agg(F.max("snapshot")).first()[0]
    return rows.where(F.col("snapshot") == last).drop("snapshot")
