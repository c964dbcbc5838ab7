"""Chat formatting of reply trees, in DataFrame operations only.

A tree's nodes have an id, a parent's id, a role, a text and a score. Jump
tables (the ancestor 1, 2, 4, ... steps up) come from iterative self-joins; the
same tables then spread every leaf over its ancestors, each distance once by its
binary digits, so a path of length n takes log n joins. Branches are ranked by
the mean score of their nodes and each chosen path becomes one conversation.

Template: <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> and a newline per turn. Inside
roles and texts every "<|", "<s>", "</s>", "[INST]" and "[/INST]" gets a backslash
after its first character (those that have some get one more), so a text cannot
make a turn, and unescape() takes exactly that one away.

Defined cases: null texts and roles are empty; a null tree id is a tree of its
own; a parent that is missing makes its node a root; nodes of a cycle and what
hangs on them have no path and are left out; of rows with the same node id each
parent link counts (use number_turns for tables where ids may repeat); ties in
score go to the smaller leaf id; no nodes give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import cut

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# The beginnings and ends of control strings in common chat templates.
_TAIL = r"(\||/?s>|/?INST\])"
NO_TREE = "\x00no tree"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*){_TAIL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*){_TAIL}", "$1$2$3")


def number_turns(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as nodes of a chain: each row replies to the one before it; equal rows follow each other."""
    rows = turns.select(F.col(tree).alias("tree_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf path: tree, leaf_id, node_id and depth from the root, 0 on."""
    links = nodes.select("tree", "node_id", "parent_id").distinct()
    known = links.select("tree", F.col("node_id").alias("parent_id")).distinct()
    jumps = [cut(links.where("parent_id IS NOT NULL").join(known, ["tree", "parent_id"], "left_semi").select("tree", "node_id", F.col("parent_id").alias("up")), "jump")]
    total = links.count()
    while not jumps[-1].isEmpty() and 1 << len(jumps) <= total:
        last = jumps[-1]
        over = last.select("tree", F.col("node_id").alias("up"), F.col("up").alias("up2"))
        jumps.append(cut(last.join(over, ["tree", "up"]).select("tree", "node_id", F.col("up2").alias("up")), "jump"))
    leaves = links.join(jumps[0].select("tree", F.col("up").alias("node_id")).distinct(), ["tree", "node_id"], "left_anti")
    out = leaves.select("tree", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("up_steps")).distinct()
    for k in reversed(range(len(jumps))):
        if k and jumps[k].isEmpty():
            continue
        far = out.join(jumps[k], ["tree", "node_id"]).select("tree", "leaf_id", F.col("up").alias("node_id"), (F.col("up_steps") + (1 << k)).alias("up_steps"))
        out = cut(out.unionByName(far), "spread")
    top = Window.partitionBy("tree", "leaf_id")
    roots = links.join(jumps[0].select("tree", "node_id").distinct(), ["tree", "node_id"], "left_anti").select("tree", "node_id", F.lit(True).alias("is_root")).distinct()
    out = out.join(roots, ["tree", "node_id"], "left").withColumn("rooted", F.max("is_root").over(top)).withColumn("last", F.max("up_steps").over(top))
    return out.where("rooted").select("tree", "leaf_id", "node_id", (F.col("last") - F.col("up_steps")).alias("depth"))


def format_trees(nodes: DataFrame, max_paths: int | None = None, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, branch_rank, branch_score, n_turns, formatted and loss_spans.

    nodes: tree_id, node_id, parent_id, role, text, score. A loss span holds the
    first code point (from 0) and the length of a learned turn's escaped text.
    """
    tree = F.coalesce(F.col("tree_id").cast("string"), F.lit(NO_TREE))
    own = nodes.select(
        tree.alias("tree"), "tree_id", F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    own = cut(own, "nodes")
    on_path = paths(own).join(own.drop("parent_id"), ["tree", "node_id"])
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    rows = on_path.select("tree", "tree_id", "leaf_id", "depth", "score", F.col("role") == learn, head.alias("head"), body.alias("body")).toDF(
        "tree", "tree_id", "leaf_id", "depth", "score", "learned", "head", "body"
    )
    along = Window.partitionBy("tree", "leaf_id").orderBy("depth", "head", "body")
    length = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("at", F.sum(length).over(along.rowsBetween(Window.unboundedPreceding, 0)) - length + F.length("head"))
    turn = F.struct("depth", "head", "body", F.col("at").cast("long").alias("at"), "learned")
    grouped = rows.groupBy("tree", "leaf_id").agg(
        F.first("tree_id").alias("tree_id"), F.avg("score").alias("branch_score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns")
    )
    rank = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf_id")
    grouped = grouped.withColumn("branch_rank", F.row_number().over(rank))
    if max_paths is not None:
        grouped = grouped.where(F.col("branch_rank") <= max_paths)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t["at"].alias("start"), F.length(t.body).cast("long").alias("length")))
    return grouped.select("tree_id", "leaf_id", "branch_rank", "branch_score", "n_turns", text.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        fields = F.split(x, r"<\|im_sep\|>")
        return F.struct(unescape(F.substr(fields[0], F.lit(len(START) + 1))).alias("role"), unescape(fields[1]).alias("text"))

    return F.transform(whole, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
