"""Quick lower bounds of KNN blocks: no neighbour is ruled out, and little else is left."""
import numpy as np
import pytest

from sparkclf.models import knn as K

KINDS = ["plain", "wide", "outliers", "far queries", "one value", "rare ones", "clusters", "far away", "tiny"]


def _block(kind, rng):
    d = 150 if kind == "wide" else 12
    x, q = rng.normal(size=(900, d)), rng.normal(size=(90, d))
    if kind == "outliers":
        x[::97] *= 1e9
        q[::11] *= 1e9
        q[1] = x[97] + 1e-3
    if kind == "far queries":
        q *= 1e12
    if kind == "one value":
        x[:] = 0.3
        q[::2] = 0.3
    if kind == "rare ones":
        x = (rng.uniform(size=x.shape) < 0.0005) * 50.0
        q = (rng.uniform(size=q.shape) < 0.1) * 50.0
    if kind == "clusters":
        x = rng.normal(size=(3, d))[rng.randint(3, size=len(x))] + 1e-7 * x
        q = x[:len(q)] + 1e-8 * q
    if kind == "far away":
        x, q = x + 1e8, q + 1e8
    if kind == "tiny":
        x, q = x * 1e-200, q * 1e-200
    return x, q


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("kind", KINDS)
def test_no_row_within_the_bound_is_ruled_out(metric, kind):
    x, q = _block(kind, np.random.RandomState(5))
    d = K.distances(q, x, metric)
    quick, some = K.Quick(x, q, x[0], metric), np.arange(len(q))[::-1].copy()
    for lo, hi in ((0, len(x)), (100, 331)):
        for nth in (0, 4, 60):
            bound = np.sort(d[some, lo:hi], axis=1)[:, nth]
            left = quick.values(some, lo, hi) <= quick.limit(some, lo, hi, bound)[:, None]
            assert left[d[some, lo:hi] <= bound[:, None]].all()
            if kind in ("plain", "wide") and nth == 4:
                assert left.sum(axis=1).max() < 25
    assert (quick.values(some, 0, len(x)) <= quick.limit(some, 0, len(x), np.full(len(q), np.inf))[:, None]).all()


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("kind", KINDS)
def test_left_pairs_hold_the_nearest(metric, kind):
    x, q = _block(kind, np.random.RandomState(6))
    d = K.distances(q, x, metric)
    quick, some = K.Quick(x, q, x[0], metric), np.arange(len(q))
    left, bound = K._left(quick, q, x, some, 0, len(x), np.full(len(q), np.inf), 5, metric)
    kth = np.sort(d, axis=1)[:, 4]
    assert (bound >= kth).all() and left[d <= kth[:, None]].all()


def test_plain_blocks_need_no_second_look(monkeypatch):
    import pyarrow as pa
    rng = np.random.RandomState(2)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(200, 64))
    monkeypatch.setattr(K, "Rough", None)
    looked = []
    real = K.paired_distances
    monkeypatch.setattr(K, "paired_distances", lambda q, t, rows, cols, m: looked.append(len(rows)) or real(q, t, rows, cols, m))
    for metric in K.METRICS:
        cells = K.Cells(x[:1], {metric: np.array([len(x)])})
        t = pa.table({"pd": K.distances(x, x[:1], metric)[:, 0], "x": pa.array(list(x), pa.list_(pa.float64())),
                      "tid": np.arange(len(x)), "label": np.zeros(len(x), np.int32)})
        qt = pa.table({"metric": [metric] * len(q), "cell": np.zeros(len(q), np.int32), "qid": np.arange(len(q)),
                       "x": pa.array(list(q), pa.list_(pa.float64())), "bound": np.full(len(q), np.inf)})
        got = K._nearest(t, qt, cells, 5)
        assert got.num_rows == 5 * len(q)
    assert sum(looked) < 0.02 * 2 * x.shape[0] * len(q)


def test_routes_are_written_by_many_tasks(spark, monkeypatch):
    rng = np.random.RandomState(1)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=8)], i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>, t boolean")
    monkeypatch.setattr(K, "CELL_ROWS", 20)
    monkeypatch.setattr(K, "PARTITION_BYTES", 8000)
    seen, route = [], K.route
    monkeypatch.setattr(K, "route", lambda *a, **k: seen.append(a[0].rdd.getNumPartitions()) or route(*a, **k))
    K.neighbours(df.where("not t"), df.where("t"), "x", "id", "y", 3, ("manhattan",)).count()
    assert seen[1] == -(-200 * 10 * 64 // 8000)
