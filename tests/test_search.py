"""Shared work of the model search against separate fits, and properties of this layer."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclf.models import batch_linear as B
from sparkclf.models import tree_cv as T
from sparkclf.models.prior import PriorModel
from sparkclf.models.spark_ml import make_estimator, with_ml_columns
from sparkclf.operators import metrics as M
from sparkclf.operators import split as S
from sparkclf.session import require_local


def _table(spark, n=240, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 1] + 0.3 * rng.normal(size=n) > 0.3).astype(int) + (classes > 2) * (x[:, 2] > 0.8)
    rows = [(i, [float(v) for v in r], int(c), i % 3) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label int, fold int")


@pytest.mark.parametrize("classes", [2, 3])
def test_batched_logistic_equals_spark_ml(spark, classes):
    df = _table(spark, classes=classes)
    data = df.select(F.col("features").alias("x"), F.col("label").alias("y"), "fold").repartition(3).cache()
    tasks = [B.LinearTask("logistic", 0.1, f) for f in range(3)]
    w = B.fit_many(data, tasks, [None], [4], classes, {0: 80, 1: 80, 2: 80})
    ml = with_ml_columns(df, "features", "label", list(range(classes)))
    for f, got in zip(range(3), w):
        m = make_estimator("Logistic Regression", {"C": 1 / (0.1 * 160)}, 160, n_classes=classes).fit(ml.where(F.col("fold") != f))
        coef = np.vstack([m.coefficientMatrix.toArray()])
        own = got[:, :-1] if got.shape[0] == coef.shape[0] else got
        assert np.allclose(own - own.mean(0) * (classes > 2), coef - coef.mean(0) * (classes > 2), atol=5e-3)
    conf = B.held_out_confusion(data, tasks, w, [None], classes)
    assert conf.sum(axis=(1, 2)).tolist() == [80, 80, 80]
    data.unpersist()


def test_batched_svm_scores_like_linear_svc(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    df = _table(spark)
    data = df.select(F.col("features").alias("x"), F.col("label").alias("y"), "fold").cache()
    tasks = [B.LinearTask("hinge", 0.01, f) for f in range(3)]
    w = B.fit_many(data, tasks, [None], [4], 2, {0: 80, 1: 80, 2: 80})
    conf = B.held_out_confusion(data, tasks, w, [None], 2)
    ml = with_ml_columns(df, "features", "label", [0, 1])
    ev = MulticlassClassificationEvaluator(labelCol="label_idx", metricName="f1")
    for f in range(3):
        m = make_estimator("SVM", {"C": 1 / (0.01 * 160)}, 160).fit(ml.where(F.col("fold") != f))
        want = ev.evaluate(m.transform(ml.where(F.col("fold") == f)))
        assert abs(B.score_confusion(conf[f], "f1_weighted") - want) < 0.04
    data.unpersist()


def _nodes(model, spark, tmp_path):
    model.write().overwrite().save(f"file://{tmp_path}/model")
    return T.read_nodes(spark, f"file://{tmp_path}/model").cache()


def _brute_cut(nodes, limit):
    """{leaf number: (node in its place, its class counts)} of one tree's rows, node by node."""
    by = {r["id"]: r for r in nodes}
    depth, parent, order = {0: 0}, {}, sorted(by)
    for i in order:
        for c in (by[i]["left"], by[i]["right"]):
            if c >= 0:
                depth[c], parent[c] = depth[i] + 1, i
    end = {i: by[i]["left"] < 0 or depth[i] >= limit for i in order}
    said = {i: int(by[i]["prediction"]) if by[i]["left"] < 0 else int(np.argmax(by[i]["stats"])) for i in order}
    for i in reversed(order):
        l, r = by[i]["left"], by[i]["right"]
        if not end[i] and end[l] and end[r] and said[l] == said[r]:
            end[i], said[i] = True, said[l]
    stand = {}
    for i in order:
        stand[i] = stand[parent[i]] if i in parent and end[stand[parent[i]]] else i
    return {n: stand[i] for n, i in enumerate(i for i in order if by[i]["left"] < 0)}


def test_cut_tree_equals_tree_of_that_depth(spark, tmp_path):
    df = with_ml_columns(_table(spark, 300, 3, 4), "features", "label", [0, 1, 2]).cache()
    deep = make_estimator("Decision Tree", {"max_depth": None}, 300).fit(df).setLeafCol("leaf")
    limits = [1, 2, 3, 5]
    votes = T.vote_table(_nodes(deep, spark, tmp_path), deep.depth, limits, False)
    leaves = deep.transform(df).select(F.lit(0).alias("job"), F.col("id").alias("row"), F.col("label_idx").cast("int").alias("y"),
                                       F.array(F.col("leaf").cast("int")).alias("leaf"))
    preds = T.predictions(leaves, votes, [1]).collect()
    for cut, limit in enumerate(limits):
        got = {r["row"]: r["pred"] for r in preds if r["cut"] == cut}
        own = make_estimator("Decision Tree", {"max_depth": limit}, 300).fit(df)
        assert got == {r["id"]: int(r["prediction"]) for r in own.transform(df).select("id", "prediction").collect()}
    df.unpersist()


def test_forest_of_300_trees_cut_as_node_by_node(spark, tmp_path):
    """Stand-ins of every leaf, votes, scores and their order of 300 trees against a plain walk over the nodes."""
    from collections import Counter
    from pyspark.ml.functions import vector_to_array
    df = with_ml_columns(_table(spark, 150, 3, 5), "features", "label", [0, 1, 2]).cache()
    m = make_estimator("Random Forest", {"n_estimators": 300, "max_depth": None}, 150).fit(df).setLeafCol("leaf")
    nodes, limits, deepest = _nodes(m, spark, tmp_path), [2, 4, 30], max(t.depth for t in m.trees)
    raw = spark.read.parquet(f"file://{tmp_path}/model/data").select("treeID", "nodeData.*")
    trees = {}
    for r in raw.select(F.col("treeID").alias("tree"), "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                        F.col("impurityStats").alias("stats"), "prediction").collect():
        trees.setdefault(r["tree"], []).append(r)
    stats = {(t, r["id"]): np.array(r["stats"]) for t, rows in trees.items() for r in rows}
    got = {(r["tree"], r["leaf"], r["cut"]): r["stand"] for r in T.stand_ins(nodes, T.leaf_chains(nodes, deepest), limits).collect()}
    want = {(t, n, c): at for t, rows in trees.items() for c, v in enumerate(limits) for n, at in _brute_cut(rows, v).items()}
    assert got == want and len({t for t, _, _ in got}) == 300

    data = m.transform(df).select(F.lit(0).alias("job"), F.col("id").alias("row"), F.col("label_idx").cast("int").alias("y"),
                                  vector_to_array("leaf").cast("array<int>").alias("leaf"), "rawPrediction").cache()
    votes = T.vote_table(nodes, deepest, limits, True).cache()
    preds = T.predictions(data.drop("rawPrediction"), votes, [7, 300]).cache()
    shares = {k: stats[k[0], at] / stats[k[0], at].sum() for k, at in want.items()}
    hits, rows = Counter(), data.collect()
    for r in rows:
        for c in range(len(limits)):
            for n in (7, 300):
                sums = sum(np.rint(shares[t, leaf, c] * T.VOTE_UNIT) for t, leaf in enumerate(r["leaf"][:n]))
                hits[c, n] += int(np.argmax(sums)) == r["y"]
                if c == 2 and n == 300:
                    assert np.allclose(sums / T.VOTE_UNIT, r["rawPrediction"].toArray())
    acc = {(r["cut"], r["n"]): r["score"] for r in T.scores(preds, "accuracy").collect()}
    assert acc == {k: v / len(rows) for k, v in hits.items()}
    f1 = {(r["cut"], r["n"]): r["score"] for r in T.scores(preds, "f1_weighted").collect()}
    pairs = {}
    for r in preds.collect():
        pairs.setdefault((r["cut"], r["n"]), np.zeros((3, 3)))[r["y"], r["pred"]] += 1
    assert all(abs(f1[k] - B.score_confusion(v, "f1_weighted")) < 1e-12 for k, v in pairs.items())
    for x in (df, nodes, data, votes, preds):
        x.unpersist()


def test_one_node_trees_and_folds_without_rows(spark):
    """A tree that never splits votes too; a fold that no row is in gives no score."""
    df = spark.createDataFrame([(i, [0.0], i % 2, i % 2) for i in range(40)], "id long, features array<double>, label int, fold int")
    data = with_ml_columns(df, "features", "label", [0, 1]).select("features_vec", "label_idx", "fold").cache()
    got = T.tree_cv("Decision Tree", data, [{"max_depth": 3}, {"max_depth": None}], 2, {0: 20, 1: 20}, 2, "accuracy", 2, 0)
    assert got.tolist() == [0.0, 0.0]
    assert np.isnan(T.tree_cv("Decision Tree", data, [{"max_depth": 3}], 3, {0: 20, 1: 20}, 2, "accuracy", 2, 0)[0])
    data.unpersist()


def test_auc_does_not_lean_on_exchange_reuse(spark):
    rng = np.random.default_rng(1)
    rows = [("m", i, int(y), 0, [1 - s, s]) for i, (y, s) in enumerate(zip(rng.random(4000) < 0.4, np.round(rng.random(4000), 3).tolist()))]
    df = spark.createDataFrame(rows, "model string, id long, y_true int, y_pred int, scores array<double>")
    values = []
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    for reuse, n in (("true", "8"), ("false", "40")):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        values.append(M.roc_auc(df).first()["roc_auc"])
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    pos = np.array([r[4][1] for r in rows if r[2]])
    neg = np.array([r[4][1] for r in rows if not r[2]])
    brute = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert all(abs(v - brute) < 1e-12 for v in values)


def test_prior_with_a_thousand_classes(spark):
    m = PriorModel([f"c{i:04d}" for i in range(1000)], [i % 7 + 1 for i in range(1000)])
    t0 = time.time()
    rows = m.predict(spark.range(200).withColumn("y", F.lit("c0001")), "id", "y").collect()
    assert time.time() - t0 < 30
    assert all(sum(r["scores"]) == 1.0 and r["scores"][m.classes.index(r["y_pred"])] == 1.0 for r in rows)


def test_split_keeps_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(S, "TARGET_BUCKET_ROWS", 20)
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), (F.col("id") % 2).alias("y"))
    out = S.train_test_split(df, "y", "id").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in out} == {(0, "train"): 400, (0, "test"): 100, (1, "train"): 400, (1, "test"): 100}
    assert S.kfold(df, "y", "id").count() == 1000
    same = df.select("y", F.lit(1).alias("x"))
    assert S.train_test_split(same, "y", None).groupBy("split").count().orderBy("split").collect()[1]["count"] == 800


def test_a_cluster_needs_a_shared_checkpoint_folder():
    require_local("local[4]")
    require_local("local")
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            require_local(master)


def test_training_with_very_many_categories(spark):
    """Beyond 256 categories the one-hot columns are one vector; it is unrolled into the features."""
    from sparkclf.models.search import LR, search_model
    from sparkclf.plans.preprocess import PrepConfig, apply_preprocessing
    from sparkclf.plans.training import assemble
    rows = [(i, f"t{i % 300}", float(i % 7), "ab"[(i % 7) > 3]) for i in range(420)]
    df = spark.createDataFrame(rows, "id long, txt string, x double, y string")
    p = apply_preprocessing(df, "y", PrepConfig(encoding="onehot", scaling="standard"), "id")
    assert p.features == ["x", "txt_onehot"]
    data = assemble(p.data, p.features, "id", "y")
    assert data.select(F.size("features")).distinct().collect()[0][0] >= 257
    r = search_model(LR, data.where("split = 'train'"), "features", "id", "y")
    assert r.best_score > 0.9 and len(r.scores) == 4


def test_confusions_equal_counted_predictions_over_blocks(spark, monkeypatch):
    """Several blocks of a job, votes counted in them, against a plain count; no row per (row, tree) is planned."""
    monkeypatch.setattr(T, "BLOCK_LEAVES", 40)
    rng = np.random.default_rng(3)
    vote = {(j, t, l, c, k): int(rng.integers(1, 4)) for j in range(2) for t in range(4) for l in range(3) for c in range(2)
            for k in range(3) if k != (t + l) % 3}
    rows = [(j, r, int(rng.integers(3)), [int(x) for x in rng.integers(0, 3, 4)]) for j in range(2) for r in range(60)]
    leaves = spark.createDataFrame(rows, "job int, row long, y int, leaf array<int>")
    votes = spark.createDataFrame([(*k, v) for k, v in vote.items()], "job int, tree int, leaf int, cut int, class int, vote long")
    want = {}
    for j, _, y, leaf in rows:
        for c in range(2):
            for n in (1, 3, 9):
                sums = [sum(vote.get((j, t, x, c, k), 0) for t, x in enumerate(leaf[:n])) for k in range(3)]
                key = (j, c, n, y, sums.index(max(sums)))
                want[key] = want.get(key, 0) + 1
    counted = T.confusions(leaves, votes, [9, 1, 3])
    got = {tuple(r)[:5]: r["c"] for r in counted.collect()}
    assert got == want
    preds = T.predictions(leaves, votes, [1, 3, 9])
    assert {tuple(r)[:5]: r["count"] for r in preds.groupBy("job", "cut", "n", "y", "pred").count().collect()} == want
    assert "Generate explode(leaf" not in counted._jdf.queryExecution().toString() and "posexplode" not in counted._jdf.queryExecution().toString()
    assert ({tuple(r)[:3]: round(r["score"], 12) for r in T.scores(counted, "f1_weighted").collect()}
            == {tuple(r)[:3]: round(r["score"], 12) for r in T.scores(preds, "f1_weighted").collect()})


def test_fits_fill_the_cores(spark, monkeypatch):
    """More fits than the caller's number run at once where the table is one partition."""
    import threading
    seen, now, lock, real = [], [0], threading.Lock(), T.make_estimator

    def count(*a, **k):
        with lock:
            now[0] += 1
            seen.append(now[0])
        time.sleep(0.5)
        with lock:
            now[0] -= 1
        return real(*a, **k)

    monkeypatch.setattr(T, "make_estimator", count)
    monkeypatch.setattr(T, "MAX_FITS", 2)
    df = with_ml_columns(_table(spark, 90), "features", "label", [0, 1]).select("features_vec", "label_idx", "fold").coalesce(1).cache()
    T.tree_cv("Decision Tree", df, [{"max_depth": 2}], 3, {0: 30, 1: 30, 2: 30}, 2, "f1_weighted", 1, 42)
    assert max(seen) == min(2, spark.sparkContext.defaultParallelism)
    df.unpersist()
