"""Chat formatting of reply trees (native).

Messages form trees by (tree, node, parent).  Root-to-leaf paths are enumerated by
iterative self-joins that double the path: after round k every node knows its
ancestors up to 2^k steps, so a tree of depth d needs log2(d) joins.  Only ids and
scores travel in these rounds.  A branch's score is the mean of its messages'
scores; the best ``top`` branches of a tree are kept (ties: the smaller leaf), and
only their texts are joined and formatted, one row per path.

The template marks turns with control strings.  Where a text or role holds one of
``CONTROL`` - also already escaped - a backslash goes in behind its first part, and
reading back takes one out, so any text survives.  The loss mask is a list of
(start, length) code point spans of the formatted conversation.

Defined cases: null role and text are empty; a missing parent makes a root; nodes
that share an id are kept as parallel branches; a null tree is a tree of its own; a null score counts as 0; a node
in a cycle has no root and so no path; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Stash, has_rows, pick

# Control strings of the template and of other public chat templates, as (first part, rest).
CONTROL = (("<", "|im_start|>"), ("<", "|im_sep|>"), ("<", "|im_end|>"), ("<", "s>"), ("<", "/s>"),
           ("[", "INST]"), ("[", "/INST]"), ("<<", "SYS>>"), ("<<", "/SYS>>"))
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_BARE = r"(<<?|\[)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>>)"
_MARKED = r"(<<?|\[)\\(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1$2$3")


def paths(nodes: DataFrame, stash: Stash, top: int = 1) -> DataFrame:
    """(tree, leaf, step, node) of the best ``top`` root-to-leaf paths of each tree; step counts from the leaf.

    nodes: (tree, node, parent, score), node and parent being unique within a tree.
    """
    up = stash.put(nodes.join(nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found")),
                              ["tree", "parent"], "left")
                   .select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("anc"),
                           F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "up")
    leaves = up.join(up.select("tree", F.col("anc").alias("node")).filter("node IS NOT NULL").distinct(),
                     ["tree", "node"], "left_anti")
    way = leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("step"), "node")
    hop, span = up.select("tree", "node", "anc"), 1
    limit = 2 * (nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    while has_rows(hop.filter("anc IS NOT NULL")):
        if span > limit:   # only nodes of a cycle still have an ancestor so far up
            break
        far = hop.filter("anc IS NOT NULL")
        way = stash.put(way.unionByName(way.join(far, ["tree", "node"])
                                        .select("tree", "leaf", (F.col("step") + span).alias("step"),
                                                F.col("anc").alias("node"))), f"way{span}")
        nxt = hop.select("tree", F.col("node").alias("anc"), F.col("anc").alias("next"))
        hop = stash.put(far.join(nxt, ["tree", "anc"]).select("tree", "node", F.col("next").alias("anc")), f"hop{span}")
        span *= 2
    branch = (way.join(up.select("tree", "node", "score", F.col("anc").isNull().alias("root")), ["tree", "node"])
                 .groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("root").alias("whole")).filter("whole"))
    best = W.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    chosen = branch.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    return way.join(chosen.select("tree", "leaf", "place"), ["tree", "leaf"])


def format_paths(messages: DataFrame, way: DataFrame) -> DataFrame:
    """(tree, place, formatted, loss): one conversation per path; loss = array of (start, length) spans.

    messages: (tree, node, role, text).
    """
    m = way.join(messages, ["tree", "node"])
    head = F.concat(F.lit(START), escape("role"), F.lit(SEP))
    body = escape("text")
    m = m.select("tree", "place", F.struct((-F.col("step")).alias("order"), head.alias("head"), body.alias("body"),
                                           (F.col("role") == "assistant").alias("loss")).alias("turn"))
    c = m.groupBy("tree", "place").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["head"])
        span = F.struct(begin.cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))
        return F.struct((begin + F.length(t["body"]) + len(END)).cast("long").alias("at"),
                        F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return c.select("tree", "place", text.alias("formatted"), F.aggregate("turns", zero, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: (tree, place, turns array<struct<role,text>>, loss_text, formatted)."""
    parts = F.split("formatted", r"<\|im_end\|>")
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.split(F.substring(p, len(START) + 1, 2147483647), r"<\|im_sep\|>"))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.select("tree", "place", F.transform(turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text"))).alias("turns"),
                            F.array_join(loss, "").alias("loss_text"), "formatted")


def format_trees(rows: DataFrame, tree_col="tree", node_col="node", parent_col="parent", role_col="role",
                 text_col="text", score_col="score", top: int = 1) -> DataFrame:
    """Reply trees to formatted conversations: (tree, place, formatted, loss).

    Rows that share (tree, node) become parallel nodes; children attach to the first of them
    (in the order of role and text).
    """
    stash = Stash(rows.sparkSession, "chat")
    r = pick(rows, tree=tree_col, key=node_col, up=parent_col, role=role_col, text=text_col, score=score_col)
    r = r.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    twin = W.partitionBy("tree", "key").orderBy("role", "text")
    r = (r.withColumn("copy", F.row_number().over(twin))
          .withColumns({"node": F.struct("key", "copy"),
                        "parent": F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("key"), F.lit(1).alias("copy")))}))
    r = r.withColumn("tree", F.struct("tree"))               # a struct joins null ids like any other
    r = stash.put(r.select("tree", "node", "parent", "role", "text", "score"), "messages")
    way = paths(r.select("tree", "node", "parent", "score"), stash, top)
    return format_paths(r.select("tree", "node", "role", "text"), way).withColumn("tree", F.col("tree.tree"))
