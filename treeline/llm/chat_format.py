"""Chat formatting of reply trees.

Replies point at their parents.  Iterated self-joins double the length of each
node's known way up, so the root is reached in as many rounds as the depth has
binary digits.  A round keeps, for each node, the node it has got to and the sum
of the scores on the way; no path is stored.  The branches of a tree are ranked by
score, and the rounds' jumps, from the longest to the shortest, then list the
nodes of the chosen branches alone: each as one row.  Each chosen path becomes one
conversation.

The template is ``<s>role[INST]text[/INST]</s>`` for each turn.  A backslash goes
before every backslash and control string inside roles and texts, so any text can
be read back.  The loss mask covers the texts of assistant turns, nothing else.

Edge cases: null texts and roles are empty.  Nodes whose parent is missing are
roots; replies that form a cycle are an error.  A null score is 0.  Turns with equal numbers are ordered by role and text; repeated rows are
turns of their own.  Nodes with a null tree id form one tree.  An empty table
gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_MARKED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.DOTALL)
#: Stands for a null tree id inside.
NO_TREE = -(1 << 63)


def escape(text: str) -> str:
    return _MARKED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask, as spans of code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"<s>{escape(role)}[INST]", escape(text), "[/INST]</s>"
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, role, at = [], "", 0
    for m in _TOKEN.finditer(text):
        if m[0][0] == "\\":
            continue
        if m[0] == "[INST]":
            role = unescape(text[at : m.start()])
        elif m[0] == "[/INST]":
            turns.append((role, unescape(text[at : m.start()])))
        at = m.end()
    return turns


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Sums up to the root, (tree, node, score), of all nodes (tree, node, parent, score), and the jumps of
    each round k: (tree, node, next), where ``next`` is 2^k replies up."""
    known = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2")).distinct()
    up = nodes.join(known, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
    now = materialize(up.select("tree", "node", F.col("n2").alias("next"), F.coalesce("score", F.lit(0)).alias("score")), "climb")
    most, done, jumps = now.count(), [], []
    while True:
        # Whole ways are done; only the others are joined again.
        done.append(now.filter("next is null"))
        rest = now.filter("next is not null")
        if rest.isEmpty():
            return reduce(DataFrame.union, done).select("tree", "node", "score"), jumps
        if 1 << len(jumps) > most:
            raise ValueError("replies form a cycle")
        jumps.append(rest.select("tree", "node", "next"))
        known = reduce(DataFrame.union, [*done, rest])
        above = known.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("next").alias("jump"), F.col("score").alias("more"))
        longer = rest.join(above, (F.col("tree") == F.col("t2")) & (F.col("next") == F.col("n2")))
        now = materialize(longer.select("tree", "node", F.col("jump").alias("next"), (F.col("score") + F.col("more")).alias("score")), "climb")


def leaves(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """(tree, node, score) of the nodes without a reply."""
    parents = nodes.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    return sums.join(parents, ["tree", "node"], "left_anti")


def paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, pos, node): the nodes from ``chosen`` (tree, leaf) up; ``pos`` is 0 there and falls by one a reply.

    Every distance is a sum of different powers of two in one way, so a node comes once.
    """
    rows = chosen.select("tree", "leaf", F.lit(0).cast("long").alias("pos"), F.col("leaf").alias("node"))
    for k, jump in reversed(list(enumerate(jumps))):
        rows = rows.join(jump, ["tree", "node"], "left")
        here, there = F.struct("pos", "node"), F.struct((F.col("pos") - (1 << k)).alias("pos"), F.col("next").alias("node"))
        both = F.when(F.col("next").isNull(), F.array(here)).otherwise(F.array(here, there))
        rows = rows.select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.pos", "x.node")
    return rows


def _format(batches):
    for b in batches:
        done = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column(1).to_pylist()]
        mask = pa.array([[{"start": s, "end": e} for s, e in m] for _, m in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.record_batch([b.column(0), b.column(2), pa.array([t for t, _ in done], pa.string()), mask], ["tree", "leaf", "formatted", "loss_mask"])


def format_trees(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, formatted, loss_mask) of the ``keep`` best branches of each tree.

    ``nodes``: tree, node, parent (long), role, text, score; a node is unique in
    its tree.  A branch's score is the sum of its nodes'; the smaller leaf wins a tie.
    """
    small_batches(nodes.sparkSession)
    nodes = nodes.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit("")), "tree": F.coalesce("tree", F.lit(NO_TREE))})
    nodes = materialize(nodes.select("tree", "node", "parent", "role", "text", "score"), "nodes")
    sums, jumps = climb(nodes)
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ends = leaves(nodes, sums).select("tree", F.col("node").alias("leaf"), "score")
    chosen = materialize(ends.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep).select("tree", "leaf"), "branches")
    turns = paths(chosen, jumps).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    out = whole.select("tree", "turns", "leaf").mapInArrow(tidy(_format), "tree long, leaf long, formatted string, loss_mask array<struct<start:int,end:int>>")
    return out.withColumn("tree", F.when(F.col("tree") != NO_TREE, F.col("tree")))


def from_turns(df: DataFrame) -> DataFrame:
    """Nodes of conversations (conv_id, turn, role, text): each turn replies to the one before and scores 1."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = df.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").cast("long").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1).cast("long").alias("score"))
