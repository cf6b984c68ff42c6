"""A content-addressed manifest of a dataset, and proofs by descent from its root.

Each row is a leaf: the SHA-256 of its fields.  The leaves of a group ascend by
id; every FAN consecutive nodes become the digest of their digests, until one is
left, the subroot of the group.  Subroots, ordered by group, grow into the root
the same way.

1. Leaves are dealt by ranges of (group, id) and numbered inside their range;
   the rows of earlier ranges are added, so no group meets in one task.
2. Every level is one grouping by (group, rank / FAN).  It writes one record per
   node: its digest and the digests of its children.  Records of all levels and
   groups are one table with the digest as key; equal subtrees share a record.
3. A leaf is addressed by the digits of its subroot's rank and of its own, most
   significant first.  Requests descend from the root one digit a step: the
   paths wanted at a depth meet the records of the depth above, take the child
   their digit names and keep the others as a segment.  Paths with a common
   front go down together, so a step has as many rows as the tree has nodes
   there, and the record of the root is read once, not once per leaf.
4. The segments of a path, reversed, lead from the leaf back to the root.

Defined results: a null field is ``-``, which no value can be; a null group is a
group of its own and comes first; a null id comes before all others; rows with
one id ascend by digest, and equal rows stand side by side, each with its own
place; a group of one leaf is its own subroot; an empty table has no root and
gives no rows.  Texts are digested whole inside their row.  Only the named
fields enter a leaf; further columns do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import stored

FAN = 8  # children of a node; digits of a rank are taken to this base
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_SEGMENTS = "array<struct<before:string,after:string>>"
POSITIONS = (1 << 33) - 1  # of a number given by monotonically_increasing_id: its place inside the partition


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    body = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _digits(rank: Column, width: Column) -> Column:
    """The rank in base FAN, with as many digits as a tree of ``width`` leaves has levels."""
    base = lambda n: F.conv(n.cast("string"), 10, FAN)
    return F.when(width > 1, F.lpad(base(rank), F.length(base(width - 1)), F.lit("0"))).otherwise(F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, the place of a row in its group ``grp``, and ``width``, the rows of the group."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows spread over ranges too
    dealt = dealt.repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, "tie").drop("tie")
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-ranges").withColumn("range", F.shiftright("at", 33))
    sizes = placed.groupBy("grp", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select(
        F.col("grp").alias("block_grp"), F.col("range").alias("block"), "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("width"))
    joined = placed.join(blocks, F.col("grp").eqNullSafe(F.col("block_grp")) & (F.col("range") == F.col("block")))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(POSITIONS)) - F.col("first").bitwiseAND(F.lit(POSITIONS))
    return joined.select(*rows.columns, rank.alias("rank"), "width")


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records (node, children) of every level over (grp, width, rank, node), and the last node of each group (grp, node)."""
    widest = nodes.agg(F.max("width")).first()[0] or 0
    records, tops, level = [], [nodes.where("width = 1").select("grp", "node")], nodes
    while widest > 1:
        run = F.sort_array(F.collect_list(F.struct("rank", "node")))
        keys = ["grp", F.ceil(F.col("width") / FAN).alias("width"), F.floor(F.col("rank") / FAN).alias("rank")]
        runs = level.where("width > 1").groupBy(*keys).agg(F.transform(run, lambda x: x["node"]).alias("children"))
        level = stored(runs.withColumn("node", digest(F.array_join("children", ""))), "merkle-level")
        records.append(level.select("node", "children"))
        tops.append(level.where("width = 1").select("grp", "node"))
        widest = -(-widest // FAN)
    return records, reduce(DataFrame.unionByName, tops)


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (grp, id, leaf, path, subroot, carried columns), ``records`` (node, children), and the digest of the root."""

    leaves: DataFrame
    records: DataFrame
    root: str | None


def build_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table.  ``carry`` names further expressions over a row that its leaf keeps."""
    carry = carry or {}
    rows = docs.select(
        F.col(group_col).alias("grp"), F.col(id_col).alias("id"), row_digest(*[F.col(c) for c in fields]).alias("leaf"), *[c.alias(n) for n, c in carry.items()])
    rows = stored(rows, "merkle-rows")  # dealing by ranges reads its rows twice: the digests, not the texts
    leaves = stored(ranked(rows, ["id", "leaf"]), "merkle-leaves")
    low, subroots = _grow(leaves.select("grp", "width", "rank", F.col("leaf").alias("node")))
    tops = ranked(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("group"), "node"), ["group"])
    tops = stored(tops, "merkle-subroots")
    high, roots = _grow(tops.select("grp", "width", "rank", "node"))
    root = roots.first()
    empty = leaves.select(F.col("leaf").alias("node"), F.array("leaf").alias("children")).limit(0)
    records = stored(reduce(DataFrame.unionByName, [*low, *high], empty).dropDuplicates(["node"]), "merkle-records")
    known = tops.select("group", F.col("node").alias("subroot"), _digits(F.col("rank"), F.col("width")).alias("front"))
    addressed = leaves.join(known, F.col("grp").eqNullSafe(F.col("group")))
    path = F.concat("front", _digits(F.col("rank"), F.col("width")))
    kept = addressed.select("grp", "id", "leaf", path.alias("path"), "subroot", *carry)
    return Manifest(stored(kept, "merkle-paths"), records, root["node"] if root else None)


def _step(above: DataFrame, wanted: DataFrame, path: str, records: DataFrame) -> DataFrame:
    """The rows of ``wanted`` one digit below ``above`` (at, node, segments), with the child they choose and one segment more."""
    opened = above.join(records, "node").select("at", "segments", "children")
    length = F.length(path)
    taken = wanted.withColumn("at", F.substring(F.col(path), F.lit(1), length - 1))
    taken = taken.withColumn("digit", F.conv(F.substring(F.col(path), length, F.lit(1)), FAN, 10).cast("int"))
    others = F.struct(
        F.array_join(F.slice("children", F.lit(1), F.col("digit")), "").alias("before"),
        F.array_join(F.slice("children", F.col("digit") + 2, F.lit(FAN)), "").alias("after"))
    down = taken.join(opened, "at")
    return down.select(*wanted.columns, F.get("children", F.col("digit")).alias("node"), F.concat("segments", F.array(others)).alias("segments"))


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Requested leaves (rows of ``manifest.leaves``; all if not given) with ``node``, the leaf that the descent reached, and ``segments`` from leaf to root."""
    requests = manifest.leaves if requests is None else requests
    depth = requests.agg(F.max(F.length("path"))).first()[0] or 0
    start = requests.sparkSession.range(1 if manifest.root else 0).select(
        F.lit("").alias("at"), F.lit(manifest.root).cast("string").alias("node"), F.array().cast(NO_SEGMENTS).alias("segments"))
    reached = [stored(start, "merkle-start")]  # a table, so that the optimizer does not turn the join with one known key into a product
    for length in range(1, depth):
        wanted = requests.where(F.length("path") > length).select(F.substring("path", 1, length).alias("down")).distinct()
        below = _step(reached[-1], wanted, "down", manifest.records)
        reached.append(stored(below.withColumnRenamed("down", "at"), "merkle-descent"))
    ends = _step(reduce(DataFrame.unionByName, reached), requests.where("path <> ''"), "path", manifest.records)
    alone = requests.where("path = ''").select("*", F.lit(manifest.root).cast("string").alias("node"), F.array().cast(NO_SEGMENTS).alias("segments"))
    return ends.unionByName(alone).withColumn("segments", F.reverse("segments"))


def proof_digest(segments: Column) -> Column:
    """Digest of all siblings from leaf to root."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(segments, leaf, lambda node, s: digest(s["before"], node, s["after"]))
