"""Trees and forests of a search grown over counted bins, a few trees a task.

Spark ML's trees see a row only through its bins: at most ``MAX_BINS`` a feature, by thresholds
from the counts of the feature's values.  So the rows of a fold are binned in one pass and counted
by (bins, class): growing, cutting and voting then take time by the number of different bins, not
of rows.  Thresholds come from the train rows of the fold alone, and from all of them.

The trees are those of Spark ML: gini gain, ceil(sqrt(features)) features drawn per node, the first
of equal gains, at least so many drawn rows in a child, leaves that name one class merged.  Spark
draws every row Poisson(1) times; m equal rows together are drawn Poisson(m) times, which is the
same law.  The draws depend on (seed, fold, minInstancesPerNode, tree) alone, where Spark's depend
on how rows lie in partitions.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BINS = 32
TABLE_BYTES = 32 << 20       # counted bins of a fold, which every task holds; larger ones are left to Spark ML
MAX_VALUES = 4 << 20         # values of one feature in the task that finds its thresholds
BLOCK_BYTES = 2 << 20        # votes that travel in one piece
NODE_BLOCK = 8192            # nodes whose histograms are held at once
VOTE_UNIT = 2 ** 40          # a leaf's class shares as whole numbers of 1 / VOTE_UNIT
TASKS_PER_CORE = 8


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Spark ML's thresholds of a continuous feature from its sorted values and how often each is met."""
    splits = min(MAX_BINS, int(counts.sum())) - 1
    if len(values) - 1 <= splits:
        return (values[:-1] + values[1:]) / 2.0
    seen = np.cumsum(counts).astype(float)
    middle = (seen[:-1] + seen[1:]) / 2.0        # a target below it is nearer to the values before than with the next one
    stride, target, at, out = seen[-1] / (splits + 1), 0.0, 0, []
    while True:
        target += stride
        at = max(at, int(np.searchsorted(middle, target, side="right")))
        if at >= len(middle):
            return np.array(out)
        out.append((values[at] + values[at + 1]) / 2.0)
        at += 1


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def fold_thresholds(rows: DataFrame, k: int, path: str) -> dict | None:
    """{left-out fold: thresholds by feature} from all other rows; None where a feature has too many values for a task.

    rows: (x array<double>, y, fold)."""
    spark = rows.sparkSession

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, fold = _matrix(b.column("x")), b.column("fold").to_numpy()
            for f in np.unique(fold):
                mine = x[fold == f]
                for j in range(x.shape[1]):
                    v, n = np.unique(mine[:, j], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"fold": pa.array(np.full(len(v), f), pa.int32()), "j": pa.array(np.full(len(v), j), pa.int32()),
                                                      "v": pa.array(v), "n": pa.array(n, pa.int64())})

    (rows.mapInArrow(count, "fold int, j int, v double, n long").groupBy("fold", "j", "v").agg(F.sum("n").alias("n"))
     .write.parquet(path))
    values = spark.read.parquet(path)
    if (values.groupBy("j").count().agg(F.max("count")).first()[0] or 0) > MAX_VALUES:
        return None

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        v, fold, n = (t.column(c).to_numpy() for c in ("v", "fold", "n"))
        order = np.argsort(v, kind="stable")
        v, fold, n = v[order], fold[order], n[order]
        u, of = np.unique(v, return_inverse=True)
        cuts = []
        for f in range(k):
            c = np.bincount(of, weights=np.where(fold != f, n, 0), minlength=len(u))
            cuts.append(thresholds(u[c > 0], c[c > 0]).tolist() if (c > 0).any() else [])
        return pa.table({"j": pa.array([key[0].as_py()] * k, pa.int32()), "f": pa.array(range(k), pa.int32()),
                         "cuts": pa.array(cuts, pa.list_(pa.float64()))})

    got = values.groupBy("j").applyInArrow(walk, "j int, f int, cuts array<double>").collect()    # k x features short lists
    return {f: [np.array(r["cuts"]) for r in sorted((r for r in got if r["f"] == f), key=lambda r: r["j"])] for f in range(k)}


def count_bins(rows: DataFrame, cuts: dict, path: str) -> DataFrame:
    """(f, row, n): per left-out fold how often a row of bins, class (two bytes) and 'is of fold f' (a byte) is met."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, fold = _matrix(b.column("x")), b.column("fold").to_numpy()
            y = b.column("y").to_numpy().astype(np.int64)
            for f, by_feature in sent.value.items():
                row = np.empty((len(x), x.shape[1] + 3), np.uint8)
                for j, c in enumerate(by_feature):
                    row[:, j] = np.searchsorted(c, x[:, j])
                row[:, -3], row[:, -2], row[:, -1] = y >> 8, y & 255, fold == f
                kinds, n = np.unique(row.view(f"V{row.shape[1]}").ravel(), return_counts=True)
                col = pa.Array.from_buffers(pa.binary(row.shape[1]), len(kinds), [None, pa.py_buffer(kinds.tobytes())])
                yield pa.RecordBatch.from_pydict({"f": pa.array(np.full(len(n), f), pa.int32()), "row": col.cast(pa.binary()),
                                                  "n": pa.array(n, pa.int64())})

    rows.mapInArrow(count, "f int, row binary, n long").groupBy("f", "row").agg(F.sum("n").alias("n")).write.parquet(path)
    sent.unpersist()
    return rows.sparkSession.read.parquet(path)


def fold_table(counted: DataFrame, f: int, features: int, classes: int):
    """(bins by group, train rows by group and class, held-out rows by group and class) of left-out fold ``f``."""
    t = counted.where(F.col("f") == f).select("row", "n").toArrow()       # at most TABLE_BYTES
    raw = np.frombuffer(b"".join(t.column("row").to_pylist()), np.uint8).reshape(t.num_rows, features + 3)
    n = t.column("n").to_numpy()
    bins, of = np.unique(np.ascontiguousarray(raw[:, :features]).view(f"V{features}").ravel(), return_inverse=True)
    y = raw[:, -3].astype(np.int64) * 256 + raw[:, -2]
    rows = np.zeros((2, len(bins), classes), np.int64)
    np.add.at(rows, (raw[:, -1].astype(int), of, y), n)
    return np.frombuffer(bins.tobytes(), np.uint8).reshape(len(bins), features), rows[0], rows[1]


def _gini(parts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Impurity of class counts (class first); terms are taken off in the order of the classes, as Spark does."""
    out = np.ones(n.shape)
    for c in parts:
        share = c / n
        out -= share * share
    return out


def grow_tree(bins: np.ndarray, weights: np.ndarray, deepest: int, least: int, drawn: int, rng) -> dict:
    """One tree over groups of rows: ``weights`` says how often a group's rows are drawn, by class.

    Nodes are numbered level by level.  Returns their class counts, parent, left child (-1 in a leaf; the
    right one follows it), the first node of every level, and the node where each group ends."""
    groups, features = bins.shape
    classes = weights.shape[1]
    flat = bins.ravel()
    stats, parent, left = [weights.sum(0).astype(float)[None]], [np.array([-1])], [np.array([-1])]
    place, rows = np.zeros(groups, np.int64), np.arange(groups)
    heavy = weights.sum(1) > 0
    first, nodes, opened = [0], 1, np.zeros(1, np.int64)
    level_of_row = np.zeros(groups, np.int64)            # a row's number among the open nodes
    for level in range(deepest):
        a = len(opened)
        if not a or not len(rows):
            break
        mine = stats[-1][opened - first[-1]]             # (open node, class)
        n = mine.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = _gini(mine.T, n)
        feats = (np.broadcast_to(np.arange(features), (a, features)) if drawn >= features
                 else np.argpartition(rng.random((a, features)), drawn - 1, axis=1)[:, :drawn])
        gain, feature, cut, of_left = np.zeros(a), np.full(a, -1), np.zeros(a, np.int64), np.zeros((a, classes))
        seen = rows[heavy[rows]]
        if a > NODE_BLOCK:
            seen = seen[np.argsort(level_of_row[seen], kind="stable")]
        at = level_of_row[seen]
        for lo in range(0, a, NODE_BLOCK):
            hi = min(a, lo + NODE_BLOCK)
            part = slice(*np.searchsorted(at, [lo, hi])) if a > NODE_BLOCK else slice(None)
            who, loc, block = seen[part], at[part] - lo, slice(lo, hi)
            w = weights[who]
            for s in range(feats.shape[1]):
                f = feats[block, s]
                key = loc * MAX_BINS + flat[who * features + f[loc]]
                lefts = np.stack([np.bincount(key, w[:, c], (hi - lo) * MAX_BINS) for c in range(classes)])
                lefts = lefts.reshape(classes, hi - lo, MAX_BINS).cumsum(2)
                total = n[block][:, None]
                nl = lefts.sum(0)
                nr = total - nl
                with np.errstate(divide="ignore", invalid="ignore"):
                    got = (impurity[block][:, None] - nl / total * _gini(lefts, nl)
                           - nr / total * _gini(mine[block].T[:, :, None] - lefts, nr))
                got[(nl < least) | (nr < least)] = -np.inf
                best = got.argmax(1)
                each = np.arange(hi - lo)
                better = np.flatnonzero(got[each, best] > gain[block])
                to = better + lo
                gain[to], feature[to], cut[to] = got[better, best[better]], f[better], best[better]
                of_left[to] = lefts[:, better, best[better]].T
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        child = np.full(a, -1)
        child[split] = nodes + 2 * np.arange(len(split))
        left[-1][opened - first[-1]] = child
        new = np.empty((2 * len(split), classes))
        new[0::2], new[1::2] = of_left[split], mine[split] - of_left[split]
        stats.append(new)
        parent.append(np.repeat(opened[split], 2))
        left.append(np.full(len(new), -1))
        loc = level_of_row[rows]
        rows, loc = rows[feature[loc] >= 0], loc[feature[loc] >= 0]
        place[rows] = child[loc] + (flat[rows * features + feature[loc]] > cut[loc])
        first.append(nodes)
        pure = _gini(new.T, new.sum(1)) < np.finfo(float).eps
        opened = nodes + np.flatnonzero(~pure)
        number = np.full(len(new), -1)
        number[~pure] = np.arange(len(opened))
        level_of_row[rows] = number[place[rows] - nodes]
        rows = rows[level_of_row[rows] >= 0]
        nodes += len(new)
    return {"stats": np.concatenate(stats), "parent": np.concatenate(parent), "left": np.concatenate(left),
            "first": np.array([*first, nodes]), "place": place}


def stand_ins(tree: dict, limit: int) -> np.ndarray:
    """The node that stands in each node's place in the tree cut at depth ``limit``.

    A node whose leaves then all name one class is a leaf itself, and the topmost such node of a way stands."""
    left, first = tree["left"], tree["first"]
    said = tree["stats"].argmax(1)
    end = left < 0
    if limit + 1 < len(first):
        end = end | (np.arange(len(left)) >= first[limit])
    for lo, hi in zip(first[-2::-1], first[::-1]):
        at = np.arange(lo, hi)[~end[lo:hi]]
        a, b = left[at], left[at] + 1
        end[at[end[a] & end[b] & (said[a] == said[b])]] = True
    stand = np.arange(len(left))
    for lo, hi in zip(first[1:-1], first[2:]):
        above = stand[tree["parent"][lo:hi]]
        stand[lo:hi] = np.where(end[above], above, stand[lo:hi])
    return stand


def tree_votes(tree: dict, limits: list[int], forest: bool, groups: np.ndarray) -> np.ndarray:
    """(group, cut, class) whole numbers: class shares in a forest, class counts in a single tree."""
    stats = tree["stats"]
    if forest:
        n = stats.sum(1, keepdims=True)
        stats = stats / np.where(n > 0, n, 1.0) * VOTE_UNIT
    vote = np.floor(stats + 0.5).astype(np.int64)
    end = tree["place"][groups]
    return np.stack([vote[stand_ins(tree, limit)[end]] for limit in limits], axis=1)


def counted_confusions(data: DataFrame, plan: list[tuple], jobs: list[tuple], limits: list[int], k: int, classes: int,
                       forest: bool, seed: int, base: str) -> DataFrame | None:
    """(job, cut, n, y, pred, c) of every (fold, minInstancesPerNode) of ``jobs``, its depth limits and tree counts.

    data: (features_vec, label_idx, fold); plan: (minInstancesPerNode, depth limit, trees) per candidate.
    None where the counted bins do not fit a task."""
    from pyspark.ml.functions import vector_to_array
    spark = data.sparkSession
    rows = data.select(vector_to_array("features_vec").alias("x"), F.col("label_idx").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    features = data.select(F.size(vector_to_array("features_vec"))).first()[0]
    cuts = fold_thresholds(rows, k, f"{base}/values")
    if cuts is None:
        return None
    counted = count_bins(rows, cuts, f"{base}/bins")
    if (counted.groupBy("f").count().agg(F.max("count")).first()[0] or 0) * (features + 3 + 16 * classes) > TABLE_BYTES:
        return None
    sent = {f: spark.sparkContext.broadcast(fold_table(counted, f, features, classes)) for f in sorted({f for f, _ in jobs})}
    drawn = math.ceil(math.sqrt(features)) if forest else features
    deep = {m: sorted({d for node, d, _ in plan if node == m}) for m, _, _ in plan}
    many = {m: sorted({n for node, _, n in plan if node == m}) for m, _, _ in plan}
    trees = sum(many[m][-1] for _, m in jobs)
    at_once = max(1, -(-trees // (TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    tasks = [(j, i, t, min(t + at_once, n)) for j, (_, m) in enumerate(jobs)
             for i, (before, n) in enumerate(zip([0, *many[m]], many[m])) for t in range(before, n, at_once)]

    def block_rows(m: int) -> int:
        return max(1, BLOCK_BYTES // (8 * classes * len(deep[m])))

    def grow(batches):
        for b in batches:
            for task in b.column("id").to_pylist():
                job, step, first, last = tasks[task]
                f, m = jobs[job]
                bins, train, held = sent[f].value
                shown = np.flatnonzero(held.any(axis=1))
                total = np.zeros((len(shown), len(deep[m]), classes), np.int64)
                for t in range(first, last):
                    rng = np.random.default_rng([seed, f, m, t])
                    weights = rng.poisson(train) if forest else train
                    tree = grow_tree(bins, weights, deep[m][-1], m, drawn, rng)
                    total += tree_votes(tree, deep[m], forest, shown)
                size = block_rows(m)
                for n, lo in enumerate(range(0, len(shown), size)):
                    yield pa.RecordBatch.from_pydict({"job": pa.array([job], pa.int32()), "block": pa.array([n], pa.int32()),
                                                      "step": pa.array([step], pa.int32()), "votes": pa.array([total[lo:lo + size].tobytes()], pa.binary())})

    def count(key: tuple, t: pa.Table) -> pa.Table:
        job, block = key[0].as_py(), key[1].as_py()
        f, m = jobs[job]
        held = sent[f].value[2]
        lo = block * block_rows(m)
        y = held[np.flatnonzero(held.any(axis=1))[lo:lo + block_rows(m)]]
        total, out = np.zeros((len(y), len(deep[m]), classes), np.int64), []
        steps = t.column("step").to_numpy()
        for i, n in enumerate(many[m]):
            for at in np.flatnonzero(steps == i):
                total += np.frombuffer(t.column("votes")[int(at)].as_py(), np.int64).reshape(total.shape)
            named, pred = total.max(axis=2) > 0, total.argmax(axis=2)
            for c, limit in enumerate(deep[m]):
                for p in np.unique(pred[named[:, c], c]):
                    hit = y[named[:, c] & (pred[:, c] == p)].sum(0)
                    out += [(job, limits.index(limit), n, int(true), int(p), int(hit[true])) for true in np.flatnonzero(hit)]
        names = ["job", "cut", "n", "y", "pred", "c"]
        return pa.table({c: pa.array(v, pa.int64() if c == "c" else pa.int32()) for c, v in zip(names, zip(*out))}) if out else pa.table(
            {c: pa.array([], pa.int64() if c == "c" else pa.int32()) for c in names})

    votes = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(grow, "job int, block int, step int, votes binary")
    part = votes.groupBy("job", "block").applyInArrow(count, "job int, cut int, n int, y int, pred int, c long")
    return part.groupBy("job", "cut", "n", "y", "pred").agg(F.sum("c").alias("c"))
