"""All depths and tree counts of a tree search from one fit per (fold, minInstancesPerNode).

Growing a tree to depth d and cutting a deeper one at d give the same tree, because a
node's split does not depend on what grows below it; and the first n trees of a forest are a forest of n trees.
So each (fold, minInstancesPerNode) is grown once, to the largest depth and tree count asked for.

The model stays a table: its saved nodes are read as a DataFrame, pointer doubling finds
every leaf's ancestors, a group per tree finds the node that stands in a leaf's place under each
depth limit (Spark merges sibling leaves with equal predictions, which is done here too),
and blocks of validation rows meet the votes of their model in a cogroup, where the votes are
added tree by tree and the predictions counted; a row per (row, tree, cut, class) never exists.
Votes are whole numbers, so the order in which they are added changes nothing.
"""
from __future__ import annotations

import functools
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, delete_path, shared_path
from .spark_ml import _depth, _min_node, make_estimator
from .tree_bins import counted_confusions

BLOCK_LEAVES = 4 << 20   # leaf numbers of validation rows that a task holds
MAX_BLOCK_TASKS = 2000
MAX_FITS = 16            # fits at once, if not more are asked for
VOTE_UNIT = 2 ** 40      # a leaf's class shares as whole numbers of 1 / VOTE_UNIT
SPARK_ROWS = 10_000      # up to here Spark ML takes its thresholds from all rows; its own growth is kept


def read_nodes(spark, path: str, job: int = 0) -> DataFrame:
    """(job, tree, id, left, right, stats, pred, said) of a model saved at ``path``.

    ``said`` is the class the node would name as a leaf: its prediction if it is one, else that of its class counts.
    """
    rows = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID").cast("int") if "nodeData" in rows.columns else F.lit(0)
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    most = F.array_position("impurityStats", F.array_max("impurityStats")) - 1
    return rows.select(F.lit(job).alias("job"), tree.alias("tree"), F.col("id").cast("int").alias("id"),
                       F.col("leftChild").cast("int").alias("left"), F.col("rightChild").cast("int").alias("right"),
                       F.col("impurityStats").alias("stats"),
                       F.when(F.col("leftChild") < 0, F.col("prediction").cast("long")).otherwise(most).alias("said"))


def leaf_chains(nodes: DataFrame, deepest: int) -> DataFrame:
    """(job, tree, leaf, chain): each leaf's nodes from the root down to itself, by pointer doubling.

    ``leaf`` is the leaf's number in its tree, in preorder, as the models name it.  Every node starts with its parent; in each round it takes over the ancestors of the
    farthest one it knows, so trees of depth d need log2(d) joins.
    """
    edge = nodes.where("left >= 0").select("job", "tree", F.explode(F.array("left", "right")).alias("id"), F.col("id").alias("top"))
    up = (nodes.select("job", "tree", "id", "left").join(edge, ["job", "tree", "id"], "left")
          .withColumn("chain", F.when(F.col("top").isNull(), F.array().cast("array<int>")).otherwise(F.array("top"))))
    for _ in range(math.ceil(math.log2(max(deepest, 1)))):
        up = cut_lineage(up)
        far = up.where("size(chain) > 0").select("job", "tree", F.col("id").alias("top"), F.col("top").alias("__top"), F.col("chain").alias("__more"))
        up = up.join(far, ["job", "tree", "top"], "left").select(
            "job", "tree", "id", "left", F.col("__top").alias("top"),
            F.concat(F.coalesce("__more", F.array().cast("array<int>")), "chain").alias("chain"))
    number = F.row_number().over(Window.partitionBy("job", "tree").orderBy("id")) - 1        # a tree is grown by one driver, so it fits
    return up.where("left < 0").select("job", "tree", number.alias("leaf"), F.concat("chain", F.array("id")).alias("chain"))


def stand_ins(nodes: DataFrame, chains: DataFrame, limits: list[int]) -> DataFrame:
    """(job, tree, leaf, cut, stand): the node in a leaf's place under depth limit number ``cut``.

    Under a limit a leaf gives way to its ancestor at that depth.  A node whose leaves then all
    name one class is merged into a leaf itself, and the topmost such node of the chain stands.
    """
    empty = pa.schema([("job", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int32()), ("cut", pa.int32()), ("stand", pa.int32())])

    def tree(key: tuple, mine: pa.Table, its: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return empty.empty_table()
        ids = its.column("id").to_numpy()
        order = np.argsort(ids)
        ids, said = ids[order], its.column("said").to_numpy()[order]
        chain = mine.column("chain").combine_chunks()
        depth = np.diff(chain.offsets.to_numpy()) - 1                    # of each leaf
        way = np.full((len(depth), depth.max() + 1), -1, np.int64)       # a leaf's nodes from the root down
        way[np.arange(way.shape[1]) <= depth[:, None]] = np.searchsorted(ids, chain.flatten().to_numpy())
        row, cuts = np.arange(len(way)), []
        for limit in limits:
            end = np.minimum(depth, limit)
            inside = np.arange(way.shape[1]) <= end[:, None]
            named = np.broadcast_to(said[way[row, end]][:, None], way.shape)[inside]
            low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
            np.minimum.at(low, way[inside], named)
            np.maximum.at(high, way[inside], named)
            cuts.append(ids[way[row, ((low == high)[way] & inside).argmax(axis=1)]])
        n, leaf = len(limits), mine.column("leaf").to_numpy()
        return pa.table([np.full(n * len(row), key[0].as_py()), np.full(n * len(row), key[1].as_py()), np.tile(leaf, n),
                         np.repeat(np.arange(n), len(row)), np.concatenate(cuts)], names=empty.names).cast(empty)

    known = nodes.select(F.col("job").alias("__job"), F.col("tree").alias("__tree"), "id", "said")     # may stem from the same table
    return (chains.groupBy("job", "tree").cogroup(known.groupBy("__job", "__tree"))
            .applyInArrow(tree, "job int, tree int, leaf int, cut int, stand int"))


def vote_table(nodes: DataFrame, deepest: int, limits: list[int], forest: bool) -> DataFrame:
    """(job, tree, leaf, cut, class, vote): whole numbers; class shares in a forest, class counts in a single tree."""
    stand = stand_ins(nodes, leaf_chains(nodes, deepest), limits)
    v = stand.join(nodes.select("job", "tree", F.col("id").alias("stand"), "stats"), ["job", "tree", "stand"])
    total = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    v = v.select("job", "tree", "leaf", "cut", total.alias("__n"), F.posexplode("stats").alias("class", "__w")).where("__w > 0")
    vote = F.round(F.col("__w") / F.col("__n") * F.lit(float(VOTE_UNIT))) if forest else F.round("__w")
    return v.select("job", "tree", "leaf", "cut", "class", vote.cast("long").alias("vote"))


def _count_votes(leaves: DataFrame, votes: DataFrame, counts: list[int], finish, schema: str) -> DataFrame:
    """``finish`` of every block of validation rows of a job: (job, row numbers, y, {n: (votes by row, cut and class)}).

    leaves: (job, row, y, leaf array), the array by tree.  A block has at most some ``BLOCK_LEAVES`` leaves; beside it a
    task holds the votes of its job's model, which Spark ML holds in every executor that applies it.
    """
    size = leaves.groupBy("job").agg(F.sum(F.size("leaf")).alias("n")).collect()       # a row per model
    blocks = leaves.sparkSession.createDataFrame([(r["job"], -(-r["n"] // BLOCK_LEAVES) or 1) for r in size], "job int, blocks int")
    mine = leaves.join(F.broadcast(blocks), "job").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    theirs = votes.join(F.broadcast(blocks), "job").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    last = sorted(set(counts))

    def block(key: tuple, rows: pa.Table, votes: pa.Table) -> pa.Table:
        tree, leaf, cut, cls = (votes.column(c).to_numpy().astype(np.int64) for c in ("tree", "leaf", "cut", "class"))
        at = rows.column("leaf").combine_chunks()
        at = at.flatten().to_numpy().reshape(len(at), -1)
        trees = at.shape[1] if len(at) else 0
        cuts, classes = cut.max(initial=0) + 1, cls.max(initial=0) + 1
        leaves_of = np.zeros(trees, np.int64)
        np.maximum.at(leaves_of, tree[tree < trees], leaf[tree < trees] + 1)
        if len(at):
            leaves_of = np.maximum(leaves_of, at.max(axis=0) + 1)
        start = np.r_[0, np.cumsum(leaves_of)]
        table = np.zeros((start[-1], cuts * classes), np.int64)
        here = tree < trees
        table[start[tree[here]] + leaf[here], cut[here] * classes + cls[here]] = votes.column("vote").to_numpy()[here]
        total, got, done = np.zeros((len(at), cuts * classes), np.int64), {}, 0
        for n in last:
            for t in range(done, min(n, trees)):
                total += table[start[t] + at[:, t]]
            done = n
            got[n] = total.reshape(len(at), cuts, classes).copy()
        return finish(key[0].as_py(), rows, got)

    parts = max(1, min(MAX_BLOCK_TASKS, sum(-(-r["n"] // BLOCK_LEAVES) for r in size)))
    theirs = theirs.withColumnsRenamed({"job": "__job", "block": "__block"})
    mine, theirs = mine.repartition(parts, "job", "block"), theirs.repartition(parts, "__job", "__block")
    return mine.groupBy("job", "block").cogroup(theirs.groupBy("__job", "__block")).applyInArrow(block, schema)


def predictions(leaves: DataFrame, votes: DataFrame, counts: list[int]) -> DataFrame:
    """(job, row, y, cut, n, pred): the class most votes of the first n trees name, the smallest of equal ones."""
    def finish(job: int, rows: pa.Table, got: dict) -> pa.Table:
        parts = []
        for n, v in got.items():
            row, cut = np.nonzero(v.max(axis=2) > 0)
            parts.append(pa.table([pa.array(np.full(len(row), job), pa.int32()), rows.column("row").take(pa.array(row)),
                                   rows.column("y").take(pa.array(row)), pa.array(cut, pa.int32()),
                                   pa.array(np.full(len(row), n), pa.int32()), pa.array(v[row, cut].argmax(axis=1), pa.int32())],
                                  names=["job", "row", "y", "cut", "n", "pred"]))
        return pa.concat_tables(parts)

    return _count_votes(leaves, votes, counts, finish, "job int, row long, y int, cut int, n int, pred int")


def confusions(leaves: DataFrame, votes: DataFrame, counts: list[int]) -> DataFrame:
    """(job, cut, n, y, pred, c): ``predictions`` counted in their tasks."""
    def finish(job: int, rows: pa.Table, got: dict) -> pa.Table:
        y, out = rows.column("y").to_numpy(), []
        for n, v in got.items():
            row, cut = np.nonzero(v.max(axis=2) > 0)
            kinds, c = np.unique(np.column_stack([cut, y[row], v[row, cut].argmax(axis=1)]), axis=0, return_counts=True)
            out.append(np.column_stack([np.full(len(c), job), kinds[:, 0], np.full(len(c), n), kinds[:, 1:], c]))
        names = ["job", "cut", "n", "y", "pred", "c"]
        return pa.table(list(np.concatenate(out).T), names=names).cast(pa.schema([(x, pa.int32()) for x in names[:-1]] + [("c", pa.int64())]))

    part = _count_votes(leaves, votes, counts, finish, "job int, cut int, n int, y int, pred int, c long")
    return part.groupBy("job", "cut", "n", "y", "pred").agg(F.sum("c").alias("c"))


def scores(preds: DataFrame, primary: str) -> DataFrame:
    """(job, cut, n, score): accuracy or support-weighted F1, from counts per class; of ``predictions`` or ``confusions``."""
    g = preds if "c" in preds.columns else preds.groupBy("job", "cut", "n", "y", "pred").agg(F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("long")
    side = F.explode(F.array(
        F.struct(F.col("y").cast("int").alias("k"), F.col("c").alias("t"), zero.alias("p"),
                 F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(zero).alias("h")),
        F.struct(F.col("pred").cast("int").alias("k"), zero.alias("t"), F.col("c").alias("p"), zero.alias("h"))))
    k = g.select("job", "cut", "n", side.alias("s")).groupBy("job", "cut", "n", "s.k").agg(
        *[F.sum(f"s.{x}").alias(x) for x in "tph"])
    hit = F.sum("h") if primary == "accuracy" else F.sum(F.col("t") * 2 * F.col("h") / (F.col("t") + F.col("p")))
    return k.groupBy("job", "cut", "n").agg((hit / F.sum("t")).alias("score"))


def tree_cv(kind: str, data: DataFrame, cands: list[dict], k: int, fold_rows: dict[int, int], classes: int, primary: str,
            parallelism: int, seed: int) -> np.ndarray:
    """Mean score over the folds of every candidate.  data: (features_vec, label_idx, fold), persisted.

    Each (fold, minInstancesPerNode) writes its model's nodes and its validation rows' leaves
    to the shared folder; cutting, voting and scoring are then one job over all of them.
    """
    from pyspark.ml.functions import vector_to_array
    spark, forest = data.sparkSession, kind == "Random Forest"
    total = sum(fold_rows.values())
    base = shared_path(spark, "trees")
    plan = [(_min_node(c), _depth(c.get("max_depth")), int(c.get("n_estimators", 100)) if forest else 1) for c in cands]
    limits, counts = sorted({d for _, d, _ in plan}), sorted({n for _, _, n in plan})
    jobs = [(f, node) for node in dict.fromkeys(p[0] for p in plan) for f in range(k)]

    def means(confused: DataFrame) -> np.ndarray:
        out = scores(confused, primary).collect()        # a number per cut model
        delete_path(spark, base)
        got = {(r["job"], r["cut"], r["n"]): r["score"] for r in out}
        found = [[got.get((j, limits.index(d), n), float("nan")) for j, (_, m) in enumerate(jobs) if m == node] for node, d, n in plan]
        return np.array([np.mean(x) for x in found])

    if total > SPARK_ROWS:
        confused = counted_confusions(data, plan, jobs, limits, k, classes, forest, seed, base)
        if confused is not None:
            return means(confused)

    def grow(job: int) -> int:
        f, node = jobs[job]
        params = {"max_depth": max(d for m, d, _ in plan if m == node), "min_samples_leaf": node,
                  "n_estimators": max(n for m, _, n in plan if m == node)}
        model = make_estimator(kind, params, total - fold_rows.get(f, 0), seed, classes).fit(data.where(F.col("fold") != f))
        model.setLeafCol("leaf")
        model.write().save(f"{base}/model{job}")
        leaf = vector_to_array("leaf") if forest else F.array("leaf")
        # a row's number is written with it, so it stays the same whatever is computed anew
        (model.transform(data.where(F.col("fold") == f))
         .select(F.lit(job).alias("job"), F.monotonically_increasing_id().alias("row"), F.col("label_idx").cast("int").alias("y"),
                 leaf.cast("array<int>").alias("leaf")).write.parquet(f"{base}/leaves{job}"))
        return max(t.depth for t in model.trees) if forest else model.depth

    # a small table is one partition, and a fit on it one task at a time: as many fits at once as fill the cores
    fill = -(-spark.sparkContext.defaultParallelism // max(1, data.rdd.getNumPartitions()))
    with ThreadPoolExecutor(max_workers=max(1, parallelism, min(fill, MAX_FITS))) as pool:
        depths = list(pool.map(grow, range(len(jobs))))
    nodes = functools.reduce(DataFrame.unionByName, [read_nodes(spark, f"{base}/model{j}", j) for j in range(len(jobs))])
    vote_table(cut_lineage(nodes), max(depths), limits, forest).write.parquet(f"{base}/votes")
    leaves = spark.read.parquet(*[f"{base}/leaves{j}" for j in range(len(jobs))])
    return means(confusions(leaves, spark.read.parquet(f"{base}/votes"), counts))
