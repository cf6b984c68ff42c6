"""Exact ranks, quantiles and row numbers that never gather one group in one task.

Every operator here first counts per value (or per block of positions), turns
the counts into prefix sums over a bounded number of buckets, and only then
looks inside the buckets.  A group holding a third of all rows is thereby
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256

# Stand-in key for a table without groups.
WHOLE = "_whole"


def _bucketed(counts: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: the number of approximate quantiles below the value, found by binary search."""
    marks = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(value, marks, buckets * 20).alias("_bounds"))
    halves = [2**i for i in range((buckets - 1).bit_length() - 1, -1, -1)]
    below = F.aggregate(
        F.array(*[F.lit(h) for h in halves]), F.lit(0),
        lambda i, h: F.when(F.get("_bounds", i + h - 1) < F.col(value), i + h).otherwise(i))
    if keys == [WHOLE]:
        bounds = F.broadcast(bounds)  # a single row
    return counts.join(bounds, keys).withColumn("_bucket", below).drop("_bounds")


def _spans(counts: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    """Bucket totals with the amount that lies before each bucket (``_before_x``) and in all (``_total_x``)."""
    totals = counts.groupBy(*keys, "_bucket").agg(*[F.sum(a).alias(f"_in_{a}") for a in amounts])
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    for a in amounts:
        totals = totals.withColumn(f"_before_{a}", F.sum(f"_in_{a}").over(upto) - F.col(f"_in_{a}"))
        totals = totals.withColumn(f"_total_{a}", F.sum(f"_in_{a}").over(whole))
    return totals


def cumulative(counts: DataFrame, keys: list[str], value: str, amounts: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Per distinct value: ``before_x`` (amount at smaller values) and ``total_x`` for every amount ``x``."""
    grouped, names = _with_keys(counts, keys)
    placed = _bucketed(grouped, names, value, buckets)
    spans = _spans(placed, names, amounts)
    inside = Window.partitionBy(*names, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(spans, [*names, "_bucket"])
    for a in amounts:
        out = out.withColumn(f"before_{a}", F.col(f"_before_{a}") + F.sum(a).over(inside) - F.col(a))
        out = out.withColumnRenamed(f"_total_{a}", f"total_{a}")
    return out.select(*keys, value, *amounts, *[f"before_{a}" for a in amounts], *[f"total_{a}" for a in amounts])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key and probability."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return quantiles_of_counts(counts, keys, value, "n", probs, buckets)


def quantiles_of_counts(
    counts: DataFrame, keys: list[str], value: str, amount: str, probs: list[float], buckets: int = BUCKETS
) -> DataFrame:
    """Quantiles of a table that holds each distinct value once with its number of rows."""
    grouped, names = _with_keys(counts, keys)
    # Nulls weigh nothing; a filter would be pushed into the counting and make it differ from other uses of it.
    counts = grouped.select(*names, value, F.when(F.col(value).isNotNull(), F.col(amount)).otherwise(0).alias("_n"))
    placed = _bucketed(counts, names, value, buckets)
    spans = _spans(placed, names, ["_n"])

    def wanted(total: Column) -> Column:
        cells = []
        for p in probs:
            at = (total - 1) * F.lit(float(p))
            for edge, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                cells.append(F.struct(F.lit(float(p)).alias("prob"), F.lit(edge).alias("edge"), rank.alias("rank"), at.alias("at")))
        return F.array(*cells)

    def held(start: Column, size: Column) -> Column:
        return F.filter(wanted(F.col("_total__n")), lambda c: (c["rank"] >= start) & (c["rank"] < start + size))

    hit = spans.where(F.size(held(F.col("_before__n"), F.col("_in__n"))) > 0)
    inside = Window.partitionBy(*names, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        placed.join(hit, [*names, "_bucket"])
        .withColumn("_start", F.col("_before__n") + F.sum("_n").over(inside) - F.col("_n"))
        .withColumn("_cell", F.explode(held(F.col("_start"), F.col("_n"))))
    )
    pair = ranked.groupBy(*names, F.col("_cell.prob").alias("prob")).agg(
        F.max("_cell.at").alias("_at"),
        F.max(F.when(F.col("_cell.edge") == "lo", F.col(value))).alias("_lo"),
        F.max(F.when(F.col("_cell.edge") == "hi", F.col(value))).alias("_hi"),
    )
    mixed = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    return pair.select(*keys, "prob", mixed.cast("double").alias("value"))


def spread(long: DataFrame, keys: list[str], named: dict[str, float]) -> DataFrame:
    """Quantile rows as one column per name."""
    picks = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in named.items()]
    return long.groupBy(*keys).agg(*picks)


def row_index(
    df: DataFrame, keys: list[str], order: str, block: Column, limit: int | None = None, name: str = "row_index"
) -> DataFrame:
    """0-based rank of each row inside its key, and the key's row count (``key_rows``).

    ``block`` must grow with ``order`` and split a large key into many parts:
    rows are numbered inside their block and the rows of earlier blocks added.
    With ``limit`` only the first rows are returned, and blocks that start
    beyond it are dropped before their rows are sorted.
    """
    tagged = df.withColumn("_block", block)
    counts = tagged.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys, "_block", (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"), F.sum("_n").over(whole).alias("key_rows"))
    if limit is not None:
        offsets = offsets.where(F.col("_offset") < limit)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    out = tagged.join(offsets, [*keys, "_block"]).withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
    if limit is not None:
        out = out.where(F.col(name) < limit)
    return out.drop("_block", "_offset")


def position_block(position: str, width: int = 4096) -> Column:
    """Block for integer positions."""
    return F.floor(F.col(position) / F.lit(width))


def hash_block(hexadecimal: str, digits: int = 3) -> Column:
    """Block for hexadecimal digests: their first digits."""
    return F.substring(hexadecimal, 1, digits)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_row")
    picked = df.groupBy(*keys).agg(packed)
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key.  The rank filter also runs before the shuffle, so each task sends at most ``k`` per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _with_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn(WHOLE, F.lit(0)), [WHOLE])
