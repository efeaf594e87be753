"""Searches side by side, KNN blocks by rough distances, splits whose joins send the small side."""
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkclf.models import common as C
from sparkclf.models import knn as K
from sparkclf.models import search as SM
from sparkclf.operators import encode as E
from sparkclf.operators import split as S


def _tables(x, q, cell):
    pd_ = K.distances(x, cell.pivots, cell_metric(cell))[:, 0]
    t = pa.table({"pd": pd_, "x": pa.array(list(x), pa.list_(pa.float64())), "tid": np.arange(len(x))[::-1].copy(),
                  "label": np.zeros(len(x), np.int32)})
    n = len(q)
    return t, pa.table({"metric": [cell_metric(cell)] * n, "cell": np.zeros(n, np.int32), "qid": np.arange(n),
                        "x": pa.array(list(q), pa.list_(pa.float64())), "bound": np.full(n, np.inf)})


def cell_metric(cell):
    return next(iter(cell.count))


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("kind", ["plain", "copies", "far from the origin", "huge"])
def test_block_equals_brute_force(metric, kind):
    rng = np.random.RandomState(3)
    x, q = rng.normal(size=(700, 9)), rng.normal(size=(60, 9))
    if kind == "copies":
        x, q = np.round(x[:, :3]), np.round(q[:, :3])
    if kind == "far from the origin":
        x, q = x + 1e7, q + 1e7
    if kind == "huge":
        x, q = x * 1e35, q * 1e35
    cell = K.Cells(x[:1], {metric: np.array([len(x)])})
    t, qt = _tables(x, q, cell)
    got = K._nearest(t, qt, cell, 5)
    diff = q[:, None, :] - x[None]
    d = np.sqrt((diff * diff).sum(2)) if metric == "euclidean" else np.abs(diff).sum(2)
    want = {(i, int(len(x) - 1 - c), float(d[i, c])) for i in range(len(q))
            for c in np.lexsort((np.arange(len(x))[::-1], d[i]))[:5]}
    assert set(zip(got["qid"].to_pylist(), got["tid"].to_pylist(), got["dist"].to_pylist())) == want


def test_copies_beyond_k_take_no_part():
    x = np.array([[1.0, 2.0]] * 5 + [[0.0, 1.0]])
    assert K.first_copies(x, np.array([9, 3, 7, 1, 5, 0]), 2).tolist() == [1, 3, 5]


def test_blocks_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 50)
    rng = np.random.RandomState(1)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=4)], i % 5 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>, t boolean")
    nb = K._compare
    seen = []
    monkeypatch.setattr(K, "_compare", lambda *a: seen.append(nb(*a)) or seen[-1])
    K.neighbours(df.where("not t"), df.where("t"), "x", "id", "y", 3, ("manhattan",)).count()
    assert max(s.rdd.getNumPartitions() for s in seen) >= 8


def test_searches_run_side_by_side(spark, monkeypatch):
    met = threading.Barrier(2, timeout=60)

    def search(name, *_):
        met.wait()                                   # each waits until the other has begun
        return SM.SearchResult(name, 0.5, {}, 0.0, "grid")

    monkeypatch.setattr(SM, "search_model", search)
    res, table = SM.train_and_optimize(spark.range(1), "x", "id", "y", names=("a", "b"))
    assert list(res) == ["a", "b"] and table.count() == 2


def test_rows_spread_over_cores(spark):
    d = spark.range(5000).coalesce(1)
    assert C.spread(d, 5000, 256).rdd.getNumPartitions() == 4
    assert C.spread(d, 5000, 1 << 20).rdd.getNumPartitions() == 625


def test_split_joins_send_the_small_side(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "id long, y int")
    for t in (S.train_test_split(df, "y", "id"), S.kfold(df, "y", "id")):
        assert "rightHint=(strategy=broadcast)" in t._jdf.queryExecution().analyzed().toString() or \
            "ResolvedHint (strategy=broadcast)" in t._jdf.queryExecution().analyzed().toString()


def test_copies_without_id_are_numbered_in_runs(spark, monkeypatch):
    df = spark.createDataFrame([("a",)] * 95 + [("b",)] * 3 + [(None,)] * 20, "v string")
    whole = S._with_row_id(df)
    monkeypatch.setattr(S, "COPIES_AT_ONCE", 10)
    runs = S._with_row_id(df)
    assert whole.count() == 118 and whole.select("__id").distinct().count() == 118
    assert whole.exceptAll(runs).count() == 0 and runs.exceptAll(whole).count() == 0
    assert runs.select(F.spark_partition_id()).distinct().count() > 2


def test_long_values_are_ranked_in_partitions_of_bounded_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(f"{i % 300:03d}" * 40, f"k{i % 7}") for i in range(600)], "v string, w string")
    whole = E.dictionary_fit(df, ["v", "w"])
    asked, ranked = [], E.global_positions
    monkeypatch.setattr(E, "RANK_BYTES", 4000)
    monkeypatch.setattr(E, "global_positions", lambda *a: asked.append(a[3:]) or ranked(*a))
    parts = E.dictionary_fit(df, ["v", "w"])
    assert asked == [(307, 307 // 10)]                        # 36,014 bytes of values
    assert whole.table.exceptAll(parts.table).count() == 0 and parts.table.exceptAll(whole.table).count() == 0
