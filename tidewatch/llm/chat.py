"""Chat formatting: the best path of each reply tree as one conversation, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, same

START, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that a text may not hold unescaped: the template's own and those of common templates.
CONTROL = (START, SAYS, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_AFTER = "|".join(re.escape(c) for c in CONTROL)


def escape(text: Column) -> Column:
    """A backslash is doubled, and one is put after the first character of every control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(?=(?:{_AFTER}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(nodes: DataFrame, tree: str, node: str, parent: str, score: str, per_tree: int = 1) -> DataFrame:
    """The `per_tree` best root-to-leaf paths of each tree: (tree, leaf, place, node), place from 0.

    A path's score is the mean of its nodes' scores (null counts 0); ties go to the longer path, then
    to the smaller leaf. Pointer doubling: round k joins every node's 2^k-th ancestor to itself, and
    the paths found so far to those ancestors, so a tree of depth d takes log2(d) self-joins, and only
    ids move. A node whose parent is null or absent is a root; a node that is its own ancestor is on
    no path from a root and is left out. Of the rows of one node the least by parent (null first), then
    score, counts. Scores are added in their own order, so that reruns agree on ties.
    """
    n = nodes.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    n = cut(n.where("n is not null").groupBy("t", "n").agg(F.min(F.struct("p", "s")).alias("one")).select("t", "n", "one.p", "one.s"))
    ids = n.select(F.col("t").alias("t2"), F.col("n").alias("n2"))
    up = n.join(ids, same(F.col("t"), F.col("t2")) & (F.col("p") == F.col("n2")), "left").select("t", F.col("n").alias("x"), F.col("n2").alias("up"))
    parents = up.where("up is not null").select(F.col("t").alias("t2"), F.col("up").alias("p2")).distinct()
    leaves = n.join(parents, same(F.col("t"), F.col("t2")) & (F.col("n") == F.col("p2")), "left_anti")
    paths = leaves.select("t", F.col("n").alias("leaf"), F.col("n").alias("x"), F.lit(0).cast("long").alias("above"))
    count, step = n.count(), 1
    jump = cut(up.where("up is not null"))
    while step <= count and not jump.isEmpty():
        j = jump.select(F.col("t").alias("t2"), F.col("x").alias("x2"), "up")
        more = paths.join(j, same(F.col("t"), F.col("t2")) & (F.col("x") == F.col("x2")))
        paths = cut(paths.unionByName(more.select("t", "leaf", F.col("up").alias("x"), (F.col("above") + step).alias("above"))))
        k = jump.select("t", F.col("x").alias("x1"), F.col("up").alias("mid"))
        jump = cut(k.join(j, same(F.col("t"), F.col("t2")) & (F.col("mid") == F.col("x2"))).select("t", F.col("x1").alias("x"), "up"))
        step *= 2
    scored = paths.join(n.select(F.col("t").alias("t2"), F.col("n").alias("n2"), "s"), same(F.col("t"), F.col("t2")) & (F.col("x") == F.col("n2")))
    branches = scored.groupBy("t", "leaf").agg(F.array_sort(F.collect_list("s")).alias("s"), F.max("above").alias("depth"))
    branches = branches.select("t", "leaf", (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")).alias("score"), "depth")
    if per_tree == 1:
        best = branches.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("depth")).alias("d"), "leaf")).alias("b")).select("t", F.col("b.leaf").alias("leaf"), (-F.col("b.d")).alias("depth"))
    else:
        from pyspark.sql import Window

        order = Window.partitionBy("t").orderBy(F.desc("score"), F.desc("depth"), "leaf")
        best = branches.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_tree).select("t", "leaf", "depth")
    b = best.select(F.col("t").alias("t2"), F.col("leaf").alias("l2"), "depth")
    chosen = paths.join(b, same(F.col("t"), F.col("t2")) & (F.col("leaf") == F.col("l2")))
    return chosen.select(F.col("t").alias(tree), "leaf", (F.col("depth") - F.col("above")).alias("place"), F.col("x").alias(node))


def format_trees(nodes: DataFrame, tree: str = "conv_id", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score", per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """One row for each chosen path: (tree, leaf, formatted, loss_spans).

    formatted is `<|turn|>role<|says|>text<|end|>` for each node from root to leaf, with control
    strings in roles and texts escaped. loss_spans are the (start, length) in code points, from 0, of
    every text whose role is `learn`: the loss mask. Null roles and texts are empty. A node that is
    given twice counts once: its least row by parent (null first), score, role and text. A tree is one output row, so its texts meet in one row;
    nothing else of a tree is gathered.
    """
    chosen = best_paths(nodes, tree, node, parent, score, per_tree)
    said = nodes.select(F.col(tree).alias("t2"), F.col(node).alias("n2"), F.col(parent).alias("p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    said = said.where("n2 is not null").groupBy("t2", "n2").agg(F.min(F.struct("p", "s", "role", "text")).alias("one")).select("t2", "n2", "one.role", "one.text")
    turns = chosen.join(said, same(chosen[tree], said.t2) & (chosen[node] == said.n2))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SAYS))
    turns = turns.select(F.col(tree), "leaf", F.struct("place", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learn).alias("learn")).alias("turn"))
    rows = turns.groupBy(tree, "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    size = lambda t: F.length(t.head) + F.length(t.body) + len(END)
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + size(t)).alias("at"),
            F.when(t.learn, F.array_append(acc.spans, F.struct((acc.at + F.length(t.head)).alias("start"), F.length(t.body).alias("length")))).otherwise(acc.spans).alias("spans"),
        ),
    ).spans
    return rows.select(tree, "leaf", F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "").alias("formatted"), starts.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.split(formatted, re.escape(END))
    full = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), SAYS, 1)).alias("role"),
        unescape(F.regexp_replace(p, rf"(?s)^.*?{re.escape(SAYS)}", "")).alias("text"),
    )
    return F.transform(full, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s.start + 1, s.length))), "")


def chain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as trees without branches: each row replies to the one before it. Ties go by role, then
    text; nulls come first; the rows of a null conversation are one conversation."""
    from pyspark.sql import Window

    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    n = F.row_number().over(order).cast("long")
    rows = turns.select(conv, role, text, n.alias("node"))
    return rows.withColumn("parent", F.nullif(F.col("node") - 1, F.lit(0))).withColumn("score", F.lit(1.0))
