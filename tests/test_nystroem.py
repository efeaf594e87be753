"""The landmark kernel: its error is measured, and its SVM decides like the exact one."""
import numpy as np
import pytest

from sparkclf.models import nystroem as N
from sparkclf.models.spark_ml import fit_spark_model


def kernel(x, y, gamma):
    return np.exp(-gamma * ((x[:, None, :] - y[None, :, :]) ** 2).sum(2))


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.RandomState(4)
    angle, far = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, 1.0, 2.2) + rng.normal(0, 0.25, 300)
    x = np.column_stack([far * np.cos(angle), far * np.sin(angle)])
    y = (np.arange(300) % 2).astype(int)
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id long, f array<double>, y int").persist(), x, y


def test_measured_error_bounds_every_pair(rings):
    df, x, _ = rings
    worst = []
    for m in (5, 40, 300):
        k = N.fit_kernel_map(df, "f", 0.7, landmarks=m)
        z = k(x)
        r = N.kernel_error(df, "f", k).first()
        real = np.abs(kernel(x, x, 0.7) - z @ z.T).max()
        assert r["rows"] == 300 and real <= r["worst"] + 1e-7 and r["mean"] <= r["worst"]
        worst.append((r["worst"], r["mean"]))
    assert worst[0] > worst[1] > worst[2] and worst[1][1] < 0.02 and worst[2][0] < 1e-6


def test_landmarks_of_repeated_and_few_rows():
    same = np.ones((50, 3))
    assert len(N.choose_landmarks(same, 8, 1)) == 1
    two = np.vstack([same, 2 * same])
    k = N.KernelMap(N.choose_landmarks(two, 8, 1), 0.5)
    assert np.allclose(k(two) @ k(two).T, kernel(two, two, 0.5))


def exact_svm(k, y, c, steps=60_000):
    """Dual of the hinge-loss SVM by pairs of most violating coordinates; returns decision values on the train rows."""
    s, a = np.where(y == 1, 1.0, -1.0), np.zeros(len(y))
    grad = -np.ones(len(y))
    q = k * np.outer(s, s)
    for _ in range(steps):
        up, low = ((s > 0) & (a < c)) | ((s < 0) & (a > 0)), ((s > 0) & (a > 0)) | ((s < 0) & (a < c))
        v = -s * grad
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-6:
            break
        step = (v[i] - v[j]) / max(1e-12, q[i, i] + q[j, j] - 2 * s[i] * s[j] * q[i, j])
        step = min(step, c - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else c - a[j])
        a[i] += s[i] * step
        a[j] -= s[j] * step
        grad += q[:, i] * s[i] * step - q[:, j] * s[j] * step
    free = (a > 1e-8) & (a < c - 1e-8)
    f = k @ (a * s)
    return f + (s[free] - f[free]).mean()


def test_decisions_match_the_exact_dual(spark, rings):
    df, x, y = rings
    fitted = fit_spark_model("SVM", df, "f", "y", [0, 1], {"C": 1.0, "kernel": "rbf", "gamma": 0.7})
    assert fitted.kernel_error < 1e-4
    got = {r["id"]: r["rawPrediction"][1] for r in fitted.model.transform(fitted._prepared(df)).select("id", "rawPrediction").collect()}
    want = exact_svm(kernel(x, x, 0.7), y, 1.0)
    mine = np.array([got[i] for i in range(300)])
    assert np.corrcoef(mine, want)[0, 1] > 0.999 and np.abs(mine - want).max() < 0.1
    assert ((mine > 0) == (want > 0)).mean() > 0.99


def test_solver_needs_only_the_landmarks_of_a_map(rings):
    """Weights, losses and held-out counts behind maps equal those on the mapped rows; the tasks map no row."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from sparkclf.models import batch_linear as B
    df, x, y = rings
    kernels = [N.KernelMap(N.choose_landmarks(x, 20, 1), g) for g in (0.7, 0.2)]
    bare = [SimpleNamespace(landmarks=k.landmarks, gamma=k.gamma, weights=k.weights, dims=k.dims) for k in kernels]
    rows = df.select(F.col("f").alias("x"), "y", (F.col("id") % 3).cast("int").alias("fold")).repartition(3)
    tasks = [B.LinearTask(loss, 0.05, f, m) for loss in ("hinge", "logistic") for m in (0, 1) for f in (0, 2)]
    sizes = {0: 100, 1: 100, 2: 100}
    got = B.fit_many(rows, tasks, bare, [k.dims for k in bare], 2, sizes)
    counts = B.held_out_confusion(rows, tasks, got, bare, 2)
    for m, k in enumerate(kernels):
        z = rows.sparkSession.createDataFrame([(r.tolist(), int(c), i % 3) for i, (r, c) in enumerate(zip(k(x), y))], "x array<double>, y int, fold int")
        mine = [i for i, t in enumerate(tasks) if t.map_id == m]
        plain = [B.LinearTask(tasks[i].loss, 0.05, tasks[i].fold) for i in mine]
        want = B.fit_many(z, plain, [None], [k.dims], 2, sizes)
        for i, w in zip(mine, want):
            assert np.allclose(k(x) @ got[i][0, :-1] + got[i][0, -1], k(x) @ w[0, :-1] + w[0, -1], atol=2e-3)
        assert np.abs(counts[mine] - B.held_out_confusion(z, plain, want, [None], 2)).max() <= 1
