"""Model registry, parameter grids / distributions and cross-validated search.

Folds come from ``kfold`` (stratified, seeded).  Every candidate of the grid gets
its mean fold score, but work that candidates share is done once: trees and
forests are grown once per (fold, minInstancesPerNode) and cut to every depth and
tree count (``tree_cv``); all logistic or SVM candidates of all folds take their
gradients from the same pass over the data (``batch_linear``).  KNN scores every (k, weighting, metric) candidate from one neighbour pass per
fold; Gaussian NB scores every smoothing from one fit per fold.  The best
candidate (first on ties) is refit on all train rows.
"""
from __future__ import annotations

import functools
import itertools
import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import classification_metrics
from ..operators.split import kfold
from .batch_linear import LinearTask, fit_many, held_out_confusion, score_confusion
from .common import partitions_for, sorted_classes, spread
from .gnb import fit_gnb
from .knn import fit_knn, neighbours
from .prior import fit_prior
from .nystroem import fit_kernel_map
from .spark_ml import _gamma, fit_spark_model, label_index, with_ml_columns
from .tree_cv import scores, tree_cv

LR, KNN, DT, NB, RF, SVM, BASE = ("Logistic Regression", "K-Nearest Neighbors", "Decision Tree", "Naive Bayes",
                                  "Random Forest", "SVM", "Rule-based (Stratified Baseline)")
MODEL_NAMES = (LR, KNN, DT, NB, RF, SVM, BASE)
SPARK_ML = (LR, DT, RF, SVM)


# The search spaces (grid search).
def param_grids() -> dict:
    return {
        LR: {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l2"]},
        KNN: {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
        DT: {"max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
        NB: {"var_smoothing": [1e-9, 1e-8, 1e-7]},
        RF: {"n_estimators": [100, 200], "max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5],
             "min_samples_leaf": [1, 2]},
        SVM: {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
        BASE: {},
    }


# The search spaces (random search).  ("uniform", loc, scale) draws
# loc + scale·U[0,1); ("randint", lo, hi) draws an integer in [lo, hi); lists are choices.
def param_distributions() -> dict:
    return {
        LR: {"C": ("uniform", 0.001, 100.0)},
        KNN: {"n_neighbors": ("randint", 3, 30), "weights": ["uniform", "distance"],
              "metric": ["euclidean", "manhattan"]},
        DT: {"max_depth": [None, 3, 5, 10, 20], "min_samples_split": ("randint", 2, 20),
             "min_samples_leaf": ("randint", 1, 10)},
        NB: {"var_smoothing": ("uniform", 1e-10, 1e-6)},
        RF: {"n_estimators": ("randint", 50, 300), "max_depth": [None, 5, 10, 20],
             "min_samples_split": ("randint", 2, 10), "min_samples_leaf": ("randint", 1, 10)},
        SVM: {"C": ("uniform", 0.01, 100.0), "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
        BASE: {},
    }


def grid_candidates(space: dict) -> list[dict]:
    keys = list(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]


def sample_candidates(space: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """Seeded draws from the distributions (driver-side; at most ``n_iter`` dicts)."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n_iter):
        d = {}
        for k in sorted(space):
            v = space[k]
            if isinstance(v, tuple) and v[0] == "uniform":
                d[k] = float(v[1] + v[2] * rng.uniform())
            elif isinstance(v, tuple) and v[0] == "randint":
                d[k] = int(rng.randint(v[1], v[2]))
            else:
                d[k] = v[int(rng.randint(len(v)))]
        out.append(d)
    return out


def candidates_table(spark, search: str = "grid", n_iter: int = 20, seed: int = 42) -> DataFrame:
    """(model, candidate, params json) for every model's candidates."""
    rows = []
    spaces = param_grids() if search == "grid" else param_distributions()
    for m in MODEL_NAMES:
        sp = spaces[m]
        if not sp:
            continue
        cands = grid_candidates(sp) if search == "grid" else sample_candidates(sp, n_iter, seed)
        rows += [(m, i, json.dumps(c, sort_keys=True)) for i, c in enumerate(cands)]
    return spark.createDataFrame(rows, "model string, candidate int, params string")


@dataclass
class SearchResult:
    model: str
    best_score: float
    best_params: dict
    training_time: float
    search_type: str
    fitted: object = None
    scores: list = field(default_factory=list)
    candidates: list = field(default_factory=list)


def each_at_once(fn, items, at_most: int = 16) -> list:
    """``fn`` of every item, in order; their Spark jobs run side by side and fill each other's idle cores."""
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(at_most, len(items)))) as pool:
        return list(pool.map(fn, items))


def _svm_key(c):
    """Linear-kernel candidates ignore gamma: equal keys are fitted once."""
    return (c.get("C"), c.get("kernel"), c.get("gamma") if c.get("kernel", "rbf") == "rbf" else None)


def _fold_rows(data) -> dict:
    return {r["fold"]: r["n"] for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}


def _tree_cv(kind, data, features, label, classes, cands, k, primary, parallelism, seed):
    """Mean fold score per tree or forest candidate, grown once per (fold, minInstancesPerNode)."""
    sizes = _fold_rows(data)
    d = (with_ml_columns(data, features, label, classes).select("features_vec", "label_idx", "fold")
         .coalesce(partitions_for(sum(sizes.values()))).persist())
    try:
        return tree_cv(kind, d, cands, k, sizes, len(classes), primary, parallelism, seed)
    finally:
        d.unpersist()


def _linear_cv(kind, data, features, label, classes, cands, k, primary, seed):
    """Mean fold score per linear candidate; all candidates and folds share every pass over the data."""
    sizes = _fold_rows(data)
    total = sum(sizes.values())
    dim = len(data.select(features).first()[0])
    maps, dims, map_of = [None], [dim], {}
    first: dict = {}                      # candidates that differ only in what their kernel ignores share a score
    tasks, owner = [], []
    for i, c in enumerate(cands):
        rbf = kind == SVM and c.get("kernel", "rbf") == "rbf"
        if first.setdefault(_svm_key(c) if kind == SVM else i, i) != i:
            continue
        if rbf and c.get("gamma") not in map_of:
            map_of[c.get("gamma")] = len(maps)
            maps.append(fit_kernel_map(data, features, _gamma(data, features, dim, c.get("gamma", "scale")), seed=seed))
            dims.append(maps[-1].dims)
        for f in range(k):
            n = max(1, total - sizes.get(f, 0))
            tasks.append(LinearTask("hinge" if kind == SVM else "logistic", 1.0 / (float(c.get("C", 1.0)) * n), f,
                                    map_of[c.get("gamma")] if rbf else 0))
            owner.append(i)
    d = data.select(F.col(features).cast("array<double>").alias("x"), label_index(label, classes).cast("int").alias("y"), "fold")
    d = spread(d, total, max(dims)).persist()
    try:
        weights = fit_many(d, tasks, maps, dims, len(classes), sizes)
        conf = held_out_confusion(d, tasks, weights, maps, len(classes))
    finally:
        d.unpersist()
    per: dict = {}
    for i, c in zip(owner, conf):
        per.setdefault(i, []).append(score_confusion(c, primary))
    key = _svm_key if kind == SVM else None
    return np.array([np.mean(per[first[key(c)] if key else i]) for i, c in enumerate(cands)])


def _knn_cv(data, features, id_col, label, classes, cands, k, primary):
    """Every (k, weights, metric) candidate from one neighbour list per fold.

    A query row's neighbours (kmax at most, rows of one id together) are gathered once, and all
    candidates are voted and counted over them; a row per (query, neighbour, candidate) never exists."""
    kmax = max(int(c["n_neighbors"]) for c in cands)
    mets = sorted({c["metric"] for c in cands})

    def fold_lists(f):
        tr = data.where(F.col("fold") != f)
        va = data.where(F.col("fold") == f)
        return neighbours(tr, va, features, id_col, label, kmax, mets).withColumn("fold", F.lit(f))

    def position(c):
        return (F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(c)) - 1).cast("int")

    nbs = functools.reduce(DataFrame.unionByName, each_at_once(fold_lists, range(k)))
    near = F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("dist").cast("double").alias("dist"),
                                                position("label").alias("ci"))))
    lists = nbs.groupBy("fold", "metric", "qid").agg(near.alias("near"))
    truth = data.select(F.col(id_col).alias("qid"), position(label).alias("y"))
    lists = lists.join(truth, "qid").select("fold", "metric", "y", *[F.col(f"near.{c}").alias(c) for c in ("rank", "dist", "ci")])
    m = scores(_knn_confusions(lists, cands, len(classes)), primary).collect()      # a number per candidate and fold
    by = {(r["cut"], r["job"]): r["score"] for r in m}
    return np.array([float(np.mean([by[i, f] for f in range(k) if (i, f) in by])) for i in range(len(cands))])


def _knn_confusions(lists, cands, classes):
    """(job: fold, cut: candidate, n, y, pred, c): votes of every candidate over a batch of neighbour lists, counted in its task.

    lists: (fold, metric, y, and by neighbour rank, dist, ci)."""
    names = ["job", "cut", "n", "y", "pred", "c"]

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            metric, fold, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("metric", "fold", "y"))
            row = np.repeat(np.arange(len(y)), pc.list_value_length(b.column("rank")).to_numpy(zero_copy_only=False))
            rank, dist, ci = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("rank", "dist", "ci"))
            for i, c in enumerate(cands):
                mine = (metric == c["metric"])[row] & (rank <= int(c["n_neighbors"]))
                at, d, said = row[mine], dist[mine], ci[mine]
                if not len(at):
                    continue
                w = np.ones(len(d))
                if c["weights"] == "distance":                    # a neighbour at no distance outvotes all others
                    hit = np.zeros(len(y), bool)
                    hit[at[d == 0]] = True
                    with np.errstate(divide="ignore"):
                        w = np.where(hit[at], (d == 0).astype(float), 1.0 / d)
                votes = np.bincount(at * classes + said, w, len(y) * classes).reshape(len(y), classes)
                voted = np.unique(at)
                kinds, n = np.unique(np.column_stack([fold[voted], y[voted], votes[voted].argmax(axis=1)]), axis=0, return_counts=True)
                cols = [kinds[:, 0], np.full(len(n), i), np.zeros(len(n)), kinds[:, 1], kinds[:, 2], n]
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)).cast(pa.int64() if x == "c" else pa.int32())
                                                  for x, v in zip(names, cols)], names)

    part = lists.mapInArrow(count, "job int, cut int, n int, y int, pred int, c long")
    return part.groupBy("job", "cut", "n", "y", "pred").agg(F.sum("c").alias("c"))


def _gnb_cv(data, features, label, cands, k, primary, id_col):
    """One fit per fold; every smoothing value is scored in the same Arrow pass."""
    sm = [float(c["var_smoothing"]) for c in cands]

    def fold_preds(f):
        tr = data.where(F.col("fold") != f)
        va = data.where(F.col("fold") == f)
        base = fit_gnb(tr, features, label)
        cls = F.array(*[F.lit(c) for c in base.classes])
        return (base.predict_many(va, features, sm)
                .select(F.col(label).alias("y_true"), F.posexplode("__idx").alias("cand", "ci"))
                .select(F.concat_ws(":", F.col("cand").cast("string"), F.lit(str(f))).alias("model"), "y_true",
                        F.element_at(cls, F.col("ci") + 1).alias("y_pred")))

    return _fold_means(each_at_once(fold_preds, range(k)), len(cands), primary)


def _fold_means(preds, n_cands, primary):
    u = preds[0]
    for p in preds[1:]:
        u = u.unionByName(p)
    metric = "accuracy" if primary == "accuracy" else "f1_weighted"
    m = classification_metrics(u).select("model", metric).collect()
    acc: dict = {}
    for r in m:
        i = int(r["model"].split(":")[0])
        acc.setdefault(i, []).append(r[metric])
    return np.array([float(np.mean(acc[i])) for i in range(n_cands)])


def search_model(name: str, train: DataFrame, features: str, id_col: str, label: str, search: str = "grid",
                 primary: str = "f1_weighted", k: int = 5, n_iter: int = 20, seed: int = 42,
                 parallelism: int = 8) -> SearchResult:
    """Tune one model by k-fold CV on ``train`` and refit the best on all of it."""
    t0 = time.time()
    tr = train.where(F.col(label).isNotNull())
    classes = sorted_classes(tr, label)
    if name == BASE:
        model = fit_prior(tr, label, seed)
        return SearchResult(name, float("nan"), {}, time.time() - t0, "none", model)
    space = (param_grids() if search == "grid" else param_distributions())[name]
    cands = grid_candidates(space) if search == "grid" else sample_candidates(space, n_iter, seed)
    data = kfold(tr, label, id_col, k, seed).persist()
    if name in (DT, RF):
        scores = _tree_cv(name, data, features, label, classes, cands, k, primary, parallelism, seed)
    elif name in (LR, SVM):
        scores = _linear_cv(name, data, features, label, classes, cands, k, primary, seed)
    elif name == KNN:
        scores = _knn_cv(data, features, id_col, label, classes, cands, k, primary)
    elif name == NB:
        scores = _gnb_cv(data, features, label, cands, k, primary, id_col)
    else:
        raise ValueError(name)
    data.unpersist()
    # the first of equal scores; equal up to the order in which folds and classes were added up
    best = int(np.argmax(np.round(np.where(np.isnan(scores), -np.inf, scores), 12)))      # a score that is no number ranks last
    bp = cands[best]
    if name in SPARK_ML:
        fitted = fit_spark_model(name, tr, features, label, classes, bp, seed)
    elif name == KNN:
        fitted = fit_knn(tr, features, id_col, label, int(bp["n_neighbors"]), bp["weights"], bp["metric"])
    else:
        fitted = fit_gnb(tr, features, label, float(bp["var_smoothing"]))
    return SearchResult(name, float(scores[best]), bp, time.time() - t0, search, fitted, [float(x) for x in scores], cands)


def train_and_optimize(train: DataFrame, features: str, id_col: str, label: str, search: str = "grid",
                       primary: str = "f1_weighted", k: int = 5, n_iter: int = 20, seed: int = 42,
                       names=MODEL_NAMES, parallelism: int = 8):
    """Search every named model; returns ({name: SearchResult}, results DataFrame).

    The searches run side by side: each is many small jobs that leave cores idle.  A model's
    training time is therefore the time it took beside the others."""
    if not 3 <= k <= 10:
        raise ValueError("cv folds must be between 3 and 10")
    if not 5 <= n_iter <= 50:
        raise ValueError("random-search iterations must be between 5 and 50")
    found = each_at_once(lambda n: search_model(n, train, features, id_col, label, search, primary, k, n_iter, seed, parallelism), names)
    out = dict(zip(names, found))
    rows = [(r.model, None if np.isnan(r.best_score) else r.best_score, json.dumps(r.best_params, sort_keys=True),
             float(r.training_time), r.search_type) for r in out.values()]
    df = train.sparkSession.createDataFrame(
        rows, "model string, best_score double, best_params string, training_time double, search_type string")
    return out, df


def predict_all(results: dict, test: DataFrame, features: str, id_col: str, label: str) -> DataFrame:
    """Union of prediction tables of every fitted model (with inference time per model)."""
    preds = []
    for name, r in results.items():
        m = r.fitted
        if name == BASE:
            p = m.predict(test, id_col, label, name)
        elif name == NB:
            p = m.predict(test, features, id_col, label, name)
        elif name == KNN:
            p = m.predict(test, name)
        else:
            p = m.predict(test, id_col, label, name)
        preds.append(p)
    u = preds[0]
    for p in preds[1:]:
        u = u.unionByName(p)
    return u


def cv_table(results_df: DataFrame) -> DataFrame:
    """Rounded CV table: best score to 4 places, training time to 3."""
    return results_df.select("model", F.round("best_score", 4).alias("best_score"), "best_params",
                             F.round("training_time", 3).alias("training_time"), "search_type")
