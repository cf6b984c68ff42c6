"""Small building blocks for combining aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_single_rows(*parts: DataFrame) -> DataFrame:
    """One row out of several one-row aggregates, by union and a final max of each column."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def melt(df: DataFrame, keys: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to (name, value) rows."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(keys, values, name, value)


def spread_out(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that arrives in fewer pieces than there are cores, for work that is heavy per row.

    A large table has many more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores else df


def explode_once(df: DataFrame, columns: list, array: Column, name: str) -> DataFrame:
    """``columns`` and one row per element of a computed array.

    The optimizer guards a plain explode with filters on the array, and pushes
    them below the projection that computes it, so that an expensive array is
    computed three times.  The outer form has no such guards; its null row for
    an empty array is dropped here.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join wide rows with a dimension; its size in bytes decides the strategy, at planning or at run time."""
    return facts.join(dimension, key, how)
