"""How a chain of filters depends on its order: every order of every filter, out of one small table of outcomes.

1. One pass over the texts gives each document one bit per filter that it fails.
   Texts that repeat are found by SHA-256; labels are joined by id.
2. Documents are counted by (part, mask of failed filters).  These cells, at most
   2^filters per part, are all that the enumeration reads.
3. A recursive query extends prefixes of orders.  It starts with every mask that
   occurs and the empty prefix; each level adds one unused letter and carries
   the bits applied so far, so a level is one step of all orders at once.  The
   row of a prefix and a mask says what happens to its documents in that step;
   joined with the cells it gives the step's metrics.  Orders with a common
   prefix share its row: 325 prefixes stand for the 600 steps of 120 orders.
4. Full orders pick the metrics of their prefixes.

Defined results: a null text counts as empty; a null group and the empty group
are one part; parts of documents only, so an empty table gives no rows; a null
id is not smaller than another and none is smaller than it, so its text is no
copy, and it has no labels; rows with the smallest id of a text are all first; a document is good
(toxic) if any of its label rows says so; each row counts, repeated rows too.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import stored
from riskloom.llm.words import word_array

MIN_WORDS = 200
MIN_DISTINCT = 50  # percent of the words
MAX_CAPITALS = 3  # percent of the code points
SYMBOLS = r"[#$%&*|]"
COPY = "E"  # the filter on repeated texts; the others look at one text only


def failures(text: Column) -> dict[str, Column]:
    """Condition under which each filter of single texts rejects one."""
    body = F.coalesce(text, F.lit(""))
    words = word_array(body)
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        "C": 100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > MAX_CAPITALS * F.length(body),
        "D": body.rlike(SYMBOLS),
    }


def outcome_cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic): documents per part and set of failed filters; and the letters, in the order of their bits."""
    text = F.col(text_col).cast("string")
    single = failures(text)
    letters = "".join(single) + COPY
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(single.values())), F.lit(0))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        bits.alias("bits"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest")), "audit-rows")
    repeated = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = stored(labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "audit-labels")
    # Both sides of each join are plain tables, so that a text or an id with very many rows can be split.
    placed = rows.join(stored(repeated, "audit-repeated"), "digest", "left")
    copy = F.when(F.col("id") > F.col("first"), 1 << (len(letters) - 1)).otherwise(0)
    placed = placed.select("id", "part", (F.col("bits") + copy).alias("mask"))
    joined = placed.join(marked, F.col("id") == F.col("label_id"), "left")
    cells = joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return stored(cells, "audit-cells"), letters


def prefix_outcomes(cells: DataFrame, letters: str) -> DataFrame:
    """(mask, filter_order, step, bit, before): every prefix of every order for each mask that occurs, with the bits applied before its last letter."""
    named = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    return cells.sparkSession.sql(f"""
        WITH RECURSIVE prefixes AS (
          SELECT mask, '' AS filter_order, 0 AS step, 0 AS bit, 0 AS before FROM {{masks}}
          UNION ALL
          SELECT mask, concat(filter_order, l.letter), step + 1, l.bit, before | prefixes.bit
          FROM prefixes LATERAL VIEW explode(filter(array({named}), f -> ((before | prefixes.bit) & f.bit) = 0)) AS l
        )
        SELECT * FROM prefixes WHERE step > 0""", masks=cells.select("mask").distinct())


def step_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """Metrics of the last step of every prefix, per part."""
    outcomes = prefix_outcomes(cells, letters)
    hit, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(0)).cast("long")

    return cells.join(outcomes, "mask").groupBy("part", "filter_order", "step").agg(
        total("n", ~hit & ~gone).alias("kept"), total("n", hit & ~gone).alias("removed"), total("n", hit & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", hit & ~gone).alias("good_lost"), total("toxic", hit & ~gone).alias("toxic_lost"))


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), one row per part, order and step."""
    cells, letters = outcome_cells(docs, labels, part_col, id_col, text_col)
    steps = stored(step_metrics(cells, letters), "audit-steps")
    shared = F.element_at(F.array(*[F.lit(factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    own = Window.partitionBy("part", F.right("filter_order", F.lit(1)))
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * shared).over(own))  # each prefix stands for all orders that begin with it
    orders = steps.where(F.col("step") == len(letters)).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("prefix", F.left("filter_order", F.col("step")))
    rest = [c for c in steps.columns if c not in ("part", "filter_order", "step")]
    found = steps.select(F.col("part"), F.col("filter_order").alias("prefix"), *rest)
    return orders.join(found, ["part", "prefix"]).select("part", "filter_order", "step", *rest)
