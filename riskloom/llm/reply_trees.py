"""Conversations out of reply trees, in DataFrame operations only.

1. A message names the message it replies to.  Rounds of self-joins double the
   reach of every message: after round k it knows its ancestor 2^k replies up
   and the score of the messages in between, and messages whose reach passes
   their root stop taking part.  A tree of depth d takes log2(d) rounds, and no
   round carries paths or texts.
2. A leaf then knows the score of its branch.  Branches are ranked by score,
   longer ones and smaller ids first among equals.
3. The chosen branches are enumerated top-down over the same jumps: a branch
   that is known at every multiple of 2^(k+1) replies from its leaf gains those
   in between from jump k, so rows grow with the messages on chosen branches.
4. The messages of a branch are put into one text: a marker opens and closes
   each turn, control strings inside texts are escaped, and a loss mask lists
   the spans of assistant texts in code points and in bytes.

Template: ``<s>``, then per turn ``[SYS] text [/SYS]`` (system), ``[INST] text
[/INST]`` (user), ``[OUT] text</s>`` (assistant) or ``[ROLE] role[/ROLE] text</s>``
(any other).  Inside texts and roles a backslash becomes ``\\b``, and the first
character of a control string becomes ``\\l`` (for ``<``) or ``\\k`` (for ``[``), which
``unescaped`` undoes.  Markers never begin with a character that could complete a
control string cut off at the end of a text.

Defined results: a null text or role is empty; a message whose parent is unknown
begins a tree; messages that reply to each other in a circle have no root and no
branch; messages that share an id are not told apart by a tree, so ids must be
unique in a tree (``as_chains`` numbers the rows of a table by turn, then role,
then text, nulls first, so repeated rows each keep their place); a null
conversation is one of its own; an empty table gives no rows.  A conversation is
one row of the result, so its messages meet in one task; nothing else does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.arrays import let
from riskloom.llm.tables import stored
from riskloom.operators.ranking import top_k

BEGIN = "<s>"
OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "[OUT] "}
CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": "</s>"}
OTHER, ROLE_END, OTHER_END = "[ROLE] ", "[/ROLE] ", "</s>"
CONTROL_TAG = r"<(?=/?s>)"
CONTROL_NAME = r"\[(?=/?(?:SYS|INST|OUT|ROLE)\])"
TURN = r"(?=\[(?:SYS|INST|OUT|ROLE)\])"
LOSS_ROLE = "assistant"
MAX_ROUNDS = 62


def escaped(text: Column) -> Column:
    body = F.replace(text, F.lit("\\"), F.lit("\\b"))
    body = F.regexp_replace(body, CONTROL_TAG, r"\\l")  # a backslash is doubled in a replacement
    return F.regexp_replace(body, CONTROL_NAME, r"\\k")


def unescaped(text: Column) -> Column:
    for mark, char in (("\\l", "<"), ("\\k", "["), ("\\b", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def as_chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, node, parent, role, text, score) where every row replies to the row before it in its conversation."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    numbered = narrow.select("tree", place.alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree, node, up) by doubling distance, and the reach (tree, node, hops, total) of every message that has a root."""
    known = messages.select(F.col("tree").alias("known_tree"), F.col("node").alias("known"))
    links = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("hops"))
    placed = links.join(known, _same("tree", "known_tree") & (F.col("parent") == F.col("known")), "left")
    state = stored(placed.select("tree", "node", F.col("known").alias("up"), "total", "hops"), "tree-links")
    tables, done = [], []
    for _ in range(MAX_ROUNDS):
        done.append(state.where("up IS NULL"))
        climbing = state.where("up IS NOT NULL")
        if climbing.isEmpty():
            break
        if tables and climbing.count() >= tables[-1].count():
            break  # only circles are left, whose messages never reach a root
        tables.append(climbing.select("tree", "node", "up"))
        above = reduce(DataFrame.unionByName, [*done, climbing]).select(
            F.col("tree").alias("up_tree"), F.col("node").alias("via"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("hops").alias("further"))
        met = climbing.join(above, _same("tree", "up_tree") & (F.col("up") == F.col("via")))
        state = stored(met.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("hops") + F.col("further")).alias("hops")), "tree-jumps")
    return tables, reduce(DataFrame.unionByName, done).drop("up")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, node, back, place, branch_score, branch_length): the messages of the ``keep`` best root-to-leaf paths of each tree.

    ``back`` counts replies from the leaf; ``place`` is the rank of the branch.
    """
    tables, reach = jumps(messages)
    answered = messages.where("parent IS NOT NULL").select(F.col("tree").alias("in_tree"), F.col("parent").alias("answered")).distinct()
    leaves = reach.join(stored(answered, "tree-answered"), _same("tree", "in_tree") & (F.col("node") == F.col("answered")), "left_anti")
    if keep == 1:  # an aggregate, which combines before it shuffles
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("low"), (-F.col("hops")).alias("short"), "node")).alias("b"))
        best = best.select("tree", F.col("b.node").alias("leaf"), F.lit(1).cast("long").alias("place"), (-F.col("b.low")).alias("branch_score"), (-F.col("b.short")).alias("branch_length"))
    else:
        ranked = top_k(leaves, ["tree"], [F.col("total").desc(), F.col("hops").desc(), F.col("node")], keep)
        best = ranked.select("tree", F.col("node").alias("leaf"), F.col("rank").alias("place"), F.col("total").alias("branch_score"), F.col("hops").alias("branch_length"))
    on_path = stored(best.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back")), "tree-leaves")
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].select(F.col("tree").alias("up_tree"), F.col("node").alias("via"), "up")
        more = on_path.join(jump, _same("tree", "up_tree") & (F.col("node") == F.col("via")))
        more = more.select("tree", "leaf", "place", "branch_score", "branch_length", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        on_path = stored(on_path.unionByName(more), "tree-paths")
    return on_path


def format_branches(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, place, branch_score, formatted, loss): one text per branch, and the spans of its loss mask.

    A span is (start, end, byte_start, byte_end), ends exclusive.
    """
    role, body = F.col("role"), escaped(F.col("text"))
    opening, closing = F.concat(F.lit(OTHER), escaped(role), F.lit(ROLE_END)), F.lit(OTHER_END)
    for name in OPEN:
        opening = F.when(role == name, OPEN[name]).otherwise(opening)
        closing = F.when(role == name, CLOSE[name]).otherwise(closing)
    texts = messages.select(
        F.col("tree").alias("text_tree"), F.col("node").alias("text_node"), (role == LOSS_ROLE).alias("loss"), opening.alias("opening"), body.alias("body"), closing.alias("closing"))
    turns = paths.join(texts, _same("tree", "text_tree") & (F.col("node") == F.col("text_node")))
    earlier = Window.partitionBy("tree", "leaf").orderBy(F.col("back").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def span(size, name: str) -> list[Column]:
        piece = size("opening") + size("body") + size("closing")
        start = F.coalesce(F.sum(piece).over(earlier), F.lit(0)) + len(BEGIN) + size("opening")
        return [start.cast("long").alias(f"{name}start"), (start + size("body")).cast("long").alias(f"{name}end")]

    placed = turns.select("tree", "leaf", "place", "branch_score", "back", "loss", F.concat("opening", "body", "closing").alias("piece"), *span(F.length, ""), *span(F.octet_length, "byte_"))
    turn = F.struct((-F.col("back")).alias("at"), "piece", "loss", F.struct("start", "end", "byte_start", "byte_end").alias("span"))
    gathered = placed.groupBy("tree", "leaf", "place", "branch_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "tree", "place", "branch_score", F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("loss"))


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best branches of each reply tree (tree, node, parent, role, text, score), each as one conversation."""
    return format_branches(messages, branches(messages, keep))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation holds."""
    pieces = F.split(F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted)), TURN)

    def turn(piece: Column) -> Column:
        def inner(opening: str, closing: str, of: Column) -> Column:
            return F.substring(of, F.lit(len(opening) + 1), F.length(of) - len(opening) - len(closing))

        rest = inner(OTHER, OTHER_END, piece)
        end = F.locate(ROLE_END, rest)
        role, text = unescaped(F.substring(rest, F.lit(1), end - 1)), F.substring(rest, end + len(ROLE_END), F.length(rest))
        for name in OPEN:
            known = F.startswith(piece, F.lit(OPEN[name]))
            role, text = F.when(known, name).otherwise(role), F.when(known, inner(OPEN[name], CLOSE[name], piece)).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, in order, as they were given."""
    def cut(raw: Column) -> Column:
        return F.transform(loss, lambda s: unescaped(F.decode(F.substring(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")), "UTF-8")))

    return let(F.encode(formatted, "UTF-8"), cut)
