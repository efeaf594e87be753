"""Metric cells: exact neighbours, with pruning that shows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclf.models import knn as K


def brute(train, query, k, metric):
    out = {}
    for qid, qx in query:
        d = [(float(np.sqrt(((qx - x) ** 2).sum()) if metric == "euclidean" else np.abs(qx - x).sum()), tid) for tid, x in train]
        out[qid] = [t for _, t in sorted(d)[:k]]
    return out


def lists(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["metric"], r["qid"]), []).append(r["tid"])
    return got


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty clusters far apart, one vector repeated many times, equal distances on a grid."""
    rng = np.random.RandomState(1)
    centres = rng.uniform(-100, 100, size=(20, 6))
    x = [centres[i % 20] + rng.normal(size=6) for i in range(900)]
    x += [centres[0]] * 250                                   # copies: ties by id
    x += [np.array([a, b, 0, 0, 0, 0], float) for a in range(8) for b in range(8)]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, f array<double>, y int").repartition(4).persist()
    return df, [(i, v) for i, v in enumerate(x)]


def test_pruned_lists_equal_unpruned_ones(spark, clustered, monkeypatch):
    df, rows = clustered
    train, query = [r for r in rows if r[0] % 7], [r for r in rows if r[0] % 7 == 0]
    for cell_rows, block in ((16, 40), (16, 8192), (10_000, 8192)):
        monkeypatch.setattr(K, "CELL_ROWS", cell_rows)
        monkeypatch.setattr(K, "TRAIN_BLOCK_ROWS", block)
        monkeypatch.setattr(K, "QUERY_BLOCK_ROWS", block)
        got = lists(K.neighbours(df.where("id % 7 <> 0"), df.where("id % 7 = 0"), "f", "id", "y", 6))
        for metric in K.METRICS:
            want = brute(train, query, 6, metric)
            assert {q: got[(metric, q)] for q in want} == want


def test_routing_skips_most_cells(spark, clustered, monkeypatch):
    df, rows = clustered
    monkeypatch.setattr(K, "CELL_ROWS", 16)
    train, query = df.where("id % 7 <> 0"), df.where("id % 7 = 0")
    dealt, cells = K.prepare(train, "f", "id", "y")
    assert dealt.count() == 2 * train.count() and int(sum(cells.count["euclidean"])) == train.count()
    nb = K.neighbours(train, query, "f", "id", "y", 6)
    q = query.select(F.col("id").alias("qid"), F.col("f").alias("x"))
    kth = nb.where("rank = 6").select("metric", "qid", F.col("dist").alias("bound"))
    routed = K.route(q.join(kth, "qid").select("metric", "qid", "x", "bound"), cells, K.METRICS, 6, bounds=True)
    everything = 2 * query.count() * len(cells.pivots)
    assert routed.count() < 0.1 * everything
    assert K.route(q, cells, K.METRICS, 6, bounds=False).count() == 2 * query.count()


def test_more_neighbours_than_rows_text_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 2)
    rows = [(f"t{i}", [float(i), 0.0], "a") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, f array<double>, y string")
    got = lists(K.neighbours(df, df, "f", "id", "y", 9, ("euclidean",)))
    assert got[("euclidean", "t0")] == ["t0", "t1", "t2", "t3", "t4"] and len(got) == 5
    none = df.limit(0)
    assert K.neighbours(none, df, "f", "id", "y", 3).count() == 0
    assert K.neighbours(df, none, "f", "id", "y", 3).count() == 0
    same = spark.createDataFrame([(i, [1.0], "a") for i in range(30)], "id long, f array<double>, y string")
    assert lists(K.neighbours(same, same.where("id < 3"), "f", "id", "y", 2, ("manhattan",))) == {
        ("manhattan", i): [0, 1] for i in range(3)}


def test_missing_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, None], "a"), (2, [1.0, 2.0], "b")], "id long, f array<double>, y string")
    with pytest.raises(Exception, match="without missing values"):
        K.neighbours(df, df, "f", "id", "y", 1).collect()
