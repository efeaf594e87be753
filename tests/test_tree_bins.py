"""Trees grown over counted bins against Spark ML's, against plain walks, and without any Spark ML fit on larger tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclf.models import search as SM
from sparkclf.models import tree_bins as B
from sparkclf.models import tree_cv as T
from sparkclf.models.spark_ml import with_ml_columns


def _data(spark, n, classes=3, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 400, n), rng.normal(size=n), rng.integers(0, 2, n), np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n))])
    y = ((x[:, 0] > 160) ^ (x[:, 1] > 0) | (rng.random(n) < 0.2)).astype(int) + (classes > 2) * (x[:, 2] * (x[:, 3] > 0)).astype(int)
    rows = [(i, [float(v) for v in r], int(c), i % k) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int, fold int")
    return (with_ml_columns(df, "features", "label", list(range(classes))).select("features_vec", "label_idx", "fold").coalesce(1).cache(),
            {f: len(range(f, n, k)) for f in range(k)})


@pytest.mark.parametrize("heavy", [False, True])
def test_thresholds_as_spark_walks_them(heavy):
    rng = np.random.default_rng(1)
    for n in (2, 20, 33, 200, 5000):
        v = np.sort(rng.normal(size=n))
        c = rng.integers(1, 5, n)
        if heavy:
            c[n // 3] = 20 * n
        stride, want, now, target = c.sum() / 32, [], c[0], c.sum() / 32
        for i in range(1, n):
            before, now = now, now + c[i]
            if abs(before - target) < abs(now - target):
                want.append((v[i - 1] + v[i]) / 2)
                target += stride
        if n <= 32 <= c.sum():
            want = [(a + b) / 2 for a, b in zip(v, v[1:])]
        if c.sum() >= 32:
            assert B.thresholds(v, c).tolist() == want


def test_tree_scores_equal_spark_ml(spark, monkeypatch):
    d, sizes = _data(spark, 900)
    cands = [{"max_depth": m, "min_samples_leaf": s} for m in (None, 3, 6) for s in (1, 4)]
    for primary in ("accuracy", "f1_weighted"):
        want = T.tree_cv(SM.DT, d, cands, 3, sizes, 3, primary, 2, 42)
        with monkeypatch.context() as m:
            m.setattr(T, "SPARK_ROWS", 0)
            m.setattr(T, "make_estimator", lambda *a, **k: pytest.fail("a Spark ML fit"))
            m.setattr(B, "NODE_BLOCK", 5)
            m.setattr(B, "BLOCK_BYTES", 4096)
            assert T.tree_cv(SM.DT, d, cands, 3, sizes, 3, primary, 2, 42).tolist() == want.tolist()
    d.unpersist()


def test_forest_search_over_many_rows_needs_no_spark_ml_fit(spark, monkeypatch):
    """Beyond 10,000 rows: scores like Spark ML's, which each took a fit per fold and leaf size over all rows."""
    d, sizes = _data(spark, 10_500, 2)
    cands = [{"n_estimators": n, "max_depth": m, "min_samples_leaf": 2} for n in (3, 12) for m in (None, 4)]
    with monkeypatch.context() as m:
        m.setattr(T, "SPARK_ROWS", 20_000)
        want = T.tree_cv(SM.RF, d, cands, 3, sizes, 2, "accuracy", 2, 42)
    monkeypatch.setattr(T, "make_estimator", lambda *a, **k: pytest.fail("a Spark ML fit"))
    got = T.tree_cv(SM.RF, d, cands, 3, sizes, 2, "accuracy", 2, 42)
    assert np.abs(got - want).max() < 0.03 and len(set(got.tolist())) > 1
    assert T.tree_cv(SM.RF, d.repartition(5), cands, 3, sizes, 2, "accuracy", 2, 42).tolist() == got.tolist()
    d.unpersist()


def test_tables_that_do_not_fit_a_task_are_left_to_spark_ml(spark, monkeypatch):
    d, sizes = _data(spark, 300, 2)
    cands = [{"max_depth": 4}]
    want = T.tree_cv(SM.DT, d, cands, 3, sizes, 2, "accuracy", 2, 42)
    monkeypatch.setattr(T, "SPARK_ROWS", 0)
    for what in ("TABLE_BYTES", "MAX_VALUES"):
        seen = []
        with monkeypatch.context() as m:
            m.setattr(B, what, 10)
            real = T.make_estimator
            m.setattr(T, "make_estimator", lambda *a, **k: seen.append(1) or real(*a, **k))
            assert T.tree_cv(SM.DT, d, cands, 3, sizes, 2, "accuracy", 2, 42).tolist() == want.tolist()
        assert len(seen) == 3
    d.unpersist()


def test_counted_bins_hold_every_row(spark, tmp_path):
    d, sizes = _data(spark, 600)
    rows = d.select(F.expr("features_vec").alias("v"), F.col("label_idx").cast("int").alias("y"), "fold")
    from pyspark.ml.functions import vector_to_array
    rows = rows.select(vector_to_array("v").alias("x"), "y", "fold")
    cuts = B.fold_thresholds(rows, 3, f"file://{tmp_path}/values")
    counted = B.count_bins(rows, cuts, f"file://{tmp_path}/bins")
    plain = rows.collect()
    for f in range(3):
        bins, train, held = B.fold_table(counted, f, 4, 3)
        want = {}
        for r in plain:
            key = tuple(int((cuts[f][j] < v).sum()) for j, v in enumerate(r["x"]))
            want.setdefault(key, np.zeros((2, 3), int))[int(r["fold"] == f), r["y"]] += 1
        assert {tuple(b): (t.tolist(), h.tolist()) for b, t, h in zip(bins.tolist(), train, held)} == {
            b: (w[0].tolist(), w[1].tolist()) for b, w in want.items()}
    d.unpersist()


def test_cut_trees_as_node_by_node():
    rng = np.random.default_rng(5)
    bins, train = rng.integers(0, 6, (300, 4)).astype(np.uint8), rng.integers(0, 4, (300, 3))
    tree = B.grow_tree(bins, rng.poisson(train), 30, 1, 2, rng)
    left, parent = tree["left"], tree["parent"]
    depth = np.zeros(len(left), int)
    for i in range(1, len(left)):
        depth[i] = depth[parent[i]] + 1
    assert (left[tree["place"]] < 0).all() and (np.diff(depth) >= 0).all() and depth.max() > 5
    inner = np.flatnonzero(left >= 0)
    assert np.array_equal(tree["stats"][inner], tree["stats"][left[inner]] + tree["stats"][left[inner] + 1])
    for limit in (1, 3, 30):
        end = {i: left[i] < 0 or depth[i] >= limit for i in range(len(left))}
        said = tree["stats"].argmax(1)
        for i in reversed(range(len(left))):
            if not end[i] and end[left[i]] and end[left[i] + 1] and said[left[i]] == said[left[i] + 1]:
                end[i] = True
        want = []
        for i in range(len(left)):
            want.append(want[parent[i]] if i and end[want[parent[i]]] else i)
        assert B.stand_ins(tree, limit).tolist() == want
