"""A keyed store for update-mode streams: batches add changed rows, reading gives the newest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskloom.streaming.collector import start

VERSION = "_version"


class TieredStore:
    """Segments of batches below one folder.

    Batch ``n`` writes its rows as ``level=0/first=n``.  A batch that ends a
    block of ``fanout`` segments of a level also merges them into one segment of
    the next level, so a row is rewritten once a level (the logarithm of the
    number of batches), a batch writes in proportion to its changes, and a
    reader opens fewer than ``fanout`` segments a level.  Repeating a batch
    writes the same segments again.

    Batch ids count up from 0 without gaps, as those of a stream do.  Rows of one
    batch must have different keys; null keys are keys like any other.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType, fanout: int = 8):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark = spark
        self.folder = folder
        self.keys = keys
        self.schema = schema
        self.fanout = fanout

    def _path(self, level: int, first: int) -> str:
        return f"{self.folder}/level={level}/first={first:012d}"

    def _rows(self, segments: list[tuple[int, int]]) -> DataFrame:
        stored = StructType([*self.schema.fields]).add(VERSION, "long")
        if not segments:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*[self._path(*s) for s in segments])

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values, VERSION), VERSION).alias("_row"))
        return last.select(*self.keys, "_row.*").select(*self.schema.names, VERSION)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Store the changed rows of one batch and merge the blocks that it completes."""
        rows = batch.select(*self.schema.names, F.lit(batch_id).cast("long").alias(VERSION))
        rows.write.mode("overwrite").parquet(self._path(0, batch_id))
        level, span = 0, self.fanout
        while (batch_id + 1) % span == 0:
            block = range(batch_id + 1 - span, batch_id + 1, span // self.fanout)
            self._newest(self._rows([(level, first) for first in block])).write.mode("overwrite").parquet(self._path(level + 1, block[0]))
            level, span = level + 1, span * self.fanout

    def segments(self) -> list[tuple[int, int]]:
        """Finished segments that no finished segment of a higher level contains: (level, first batch)."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/level=*/first=*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(marks) or []
        folders = [mark.getPath().getParent() for mark in found]
        present = {(int(f.getParent().getName().split("=")[1]), int(f.getName().split("=")[1])) for f in folders}
        top = max((level for level, _ in present), default=0)

        def inside(level: int, first: int) -> bool:
            return any((up, first - first % self.fanout**up) in present for up in range(level + 1, top + 1))

        return sorted((s for s in present if not inside(*s)), key=lambda s: s[1])

    def read(self) -> DataFrame:
        """The newest row of each key; an absent store is empty."""
        return self._newest(self._rows(self.segments())).drop(VERSION)

    def run(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Feed the store from an aggregation whose groups are the keys: every batch holds the groups that it changed."""
        writer = stream.writeStream.foreachBatch(self.add).outputMode("update").option("checkpointLocation", checkpoint)
        return start(writer, once)
