"""Naive Bayes from merged block moments, scored locally and from the parameter table."""
import numpy as np
import pytest

from sparkclf.models import gnb as G


def reference(x, y, q, smoothing):
    """Log joint densities by the textbook formula."""
    eps = smoothing * x.var(axis=0).max()
    out = []
    for c in sorted(set(y)):
        rows = x[y == c]
        var = rows.var(axis=0) + eps
        out.append(np.log(len(rows) / len(x)) - 0.5 * np.log(2 * np.pi * var).sum() - 0.5 * ((q - rows.mean(axis=0)) ** 2 / var).sum(axis=1))
    return np.array(out).T


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(3)
    x = rng.normal(size=(260, 11)) * np.logspace(-3, 3, 11) + 1e4
    y = np.where(np.arange(260) % 3 == 0, "hot", np.array([f"c{i % 9}" for i in range(260)]))
    df = spark.createDataFrame([(i, x[i].tolist(), str(y[i])) for i in range(260)], "id long, f array<double>, y string")
    return df.repartition(7).persist(), x, y


@pytest.mark.parametrize("block,held,local,class_cells,row_block", [
    (4096, 4_000_000, 2_000_000, 1_000_000, 4096), (4, 20, 2_000_000, 1_000_000, 4096), (4, 20, 0, 12, 50), (11, 1, 0, 1, 4096)])
def test_equals_the_formula(spark, data, monkeypatch, block, held, local, class_cells, row_block):
    df, x, y = data
    for name, v in (("BLOCK", block), ("HELD_CELLS", held), ("LOCAL_CELLS", local), ("CLASS_CELLS", class_cells), ("ROW_BLOCK", row_block)):
        monkeypatch.setattr(G, name, v)
    m = G.fit_gnb(df.where("id < 200"), "f", "y")
    xt, yt, xq = x[:200], y[:200], x[200:]
    assert m.classes == sorted(set(yt)) and (m.local is None) == (local == 0)
    assert m.max_var == pytest.approx(xt.var(axis=0).max())
    got = {r["id"]: r["__jll"] for r in m.log_joint(df.where("id >= 200"), "f", [1e-9, 1e-3]).collect()}
    for k, s in enumerate((1e-9, 1e-3)):
        want = reference(xt, yt, xq, s)
        for i in range(60):
            assert got[200 + i][k] == pytest.approx(want[i], rel=1e-6)
    want = reference(xt, yt, xq, 1e-9)
    for r in m.predict(df.where("id >= 200"), "f", "id", "y").collect():
        p = np.exp(want[r["id"] - 200] - want[r["id"] - 200].max())
        assert r["y_pred"] == m.classes[int(p.argmax())] and r["scores"] == pytest.approx((p / p.sum()).tolist(), abs=1e-9)
    many = {r["id"]: r["__idx"] for r in m.predict_many(df.where("id >= 200"), "f", [1e-9, 1e-3]).collect()}
    assert all(many[200 + i] == [int(reference(xt, yt, xq, s)[i].argmax()) for s in (1e-9, 1e-3)] for i in range(60))


def test_merging_is_the_variance_of_the_union():
    rng = np.random.RandomState(0)
    x = rng.normal(size=(50, 3)) + 1e6
    parts = [(len(p), p.mean(axis=0), ((p - p.mean(axis=0)) ** 2).sum(axis=0)) for p in np.split(x, [1, 7, 30])]
    n, mean, m2 = G.merge(G.merge(parts[0], parts[1]), G.merge(parts[2], parts[3]))
    assert n == 50 and mean == pytest.approx(x.mean(axis=0)) and m2 / n == pytest.approx(x.var(axis=0))


def test_rows_without_label_and_empty_tables(spark, data):
    df, _, _ = data
    m = G.fit_gnb(df.selectExpr("id", "f", "CASE WHEN id % 2 = 0 THEN y END AS y"), "f", "y")
    assert sum(m.counts) == 130
    assert m.predict(df.limit(0), "f", "id", "y").count() == 0
    none = G.fit_gnb(df.limit(0), "f", "y")
    assert none.classes == [] and none.max_var == 0.0
