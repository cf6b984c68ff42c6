"""Connected components of a table of links, as rounds of joins.

Large-star and small-star rounds (Kiveris et al., 2014) turn the links into
stars around the smallest member.  Each round is written to the shared folder,
which cuts the lineage and survives lost executors.  Nothing is collected but
two counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import shared_dir


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node it can reach."""
    both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = _stored(both, "links")
    while True:
        around = state.union(state.select("v", "u"))
        low = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = _stored(large, "links")
        root = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(root, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = _stored(small.union(root.select("u", F.col("low").alias("v"))).distinct(), "links")
        if _same(state, after):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = after


def _same(before: DataFrame, after: DataFrame) -> bool:
    def stamp(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())

    return stamp(before) == stamp(after)
