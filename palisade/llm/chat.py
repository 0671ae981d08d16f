"""Chat formatting of reply trees, in DataFrame functions only.

A message names its parent; a tree's branches are its paths from a root to a leaf. Paths are found by self-joins that double the
distance looked up: after k rounds a message knows its ancestor 2**k steps above, the score and the length of the
way there, so a thread of n messages takes log2(n) rounds. Leaves are ranked within their tree by the summed score of
their branch. The chosen branches are then marked from the leaf up with the same tables, largest distance first, and
each becomes one conversation.

Template: ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed. Within roles and texts every ``<|`` gets a backslash
after its ``<`` (and so does one that already has some), which is undone by taking one away; no control string can then
come from a text. Line feeds in roles become ``<|nl|>``. ``loss`` tells for each turn whether it is trained on (assistants').

Defined results: null texts count as empty, null roles as ``user``, null scores as 0; rows of a null tree form one tree; a parent
that does not exist makes a root; messages on a cycle are on no branch; messages with the same id in one tree are kept
apart by conversations() and are an error of the caller otherwise; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stage

#: The template's control strings.
START, END, FEED = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
_NO_TREE = -(1 << 63)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(FEED)), F.lit("\n"), escaped(text), F.lit(END))


def conversations(rows: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as trees of one branch, in the order of turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"),
                       F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("message_id", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree_id"), "message_id",
                       F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree_id, leaf_id, rank, depth (from 1 at the root) and message_id of the messages on the best branches of each tree."""
    nodes = messages.select(F.coalesce("tree_id", F.lit(_NO_TREE)).alias("tree_id"), F.col("message_id").alias("node"), "parent_id",
                            F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree_id", F.col("node").alias("parent_id"), F.lit(True).alias("exists"))
    state = stage(nodes.join(known, ["tree_id", "parent_id"], "left")
                  .select("tree_id", "node", F.when(F.col("exists"), F.col("parent_id")).alias("above"), F.col("score").alias("sum"),
                          F.lit(1).cast("long").alias("length")), "chat-links")
    inner = state.filter("above is not null").select("tree_id", F.col("above").alias("node")).distinct()
    leaves = state.select("tree_id", "node").join(inner, ["tree_id", "node"], "left_anti")
    rooted, hanging, tables = state.filter("above is null"), state.filter("above is not null"), []
    open_now, open_before = hanging.count(), None
    while open_now and open_now != open_before:  # rows that stay open hang on a cycle
        tables.append(hanging.select("tree_id", "node", "above"))
        upper = rooted.unionByName(hanging).select(
            "tree_id", F.col("node").alias("above"), F.col("above").alias("next"), F.col("sum").alias("more"), F.col("length").alias("further"))
        moved = stage(hanging.join(upper, ["tree_id", "above"])
                      .select("tree_id", "node", F.col("next").alias("above"), (F.col("sum") + F.col("more")).alias("sum"),
                              (F.col("length") + F.col("further")).alias("length")), "chat-links")
        rooted, hanging = rooted.unionByName(moved.filter("above is null")), moved.filter("above is not null")
        open_before, open_now = open_now, hanging.count()
    rooted = rooted.select("tree_id", "node", "sum", "length")
    order = Window.partitionBy("tree_id").orderBy(F.desc("sum"), F.desc("length"), "node")
    best = (leaves.join(rooted, ["tree_id", "node"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep))
    marks = best.select("tree_id", F.col("node").alias("leaf_id"), "rank", "node")
    for table in reversed(tables):
        marks = stage(marks, "chat-branches") if table is not tables[-1] else marks
        marks = marks.unionByName(marks.join(table, ["tree_id", "node"]).select("tree_id", "leaf_id", "rank", F.col("above").alias("node")))
    return (marks.join(rooted, ["tree_id", "node"])
            .select("tree_id", "leaf_id", "rank", F.col("length").alias("depth"), F.col("node").alias("message_id")))


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """tree_id, leaf_id, rank, formatted and loss (one boolean per turn): one row per chosen branch."""
    texts = messages.select(F.coalesce("tree_id", F.lit(_NO_TREE)).alias("tree_id"), "message_id",
                            F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = branches(messages, keep).join(texts, ["tree_id", "message_id"]).select(
        "tree_id", "leaf_id", "rank", F.struct("depth", formatted_turn(F.col("role"), F.col("text")).alias("turn"),
                                               (F.col("role") == "assistant").alias("loss")).alias("t"))
    made = turns.groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return made.select(F.when(F.col("tree_id") != _NO_TREE, F.col("tree_id")).alias("tree_id"), "leaf_id", "rank",
                       F.array_join("t.turn", "").alias("formatted"), F.col("t.loss").alias("loss"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part))
        role = F.replace(F.substring(role, len(START) + 1, 1 << 30), F.lit(FEED), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)
