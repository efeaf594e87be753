import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclf.operators import encode as E
from sparkclf.operators import split as S
from sparkclf.plans import fixtures as fx
from conftest import SF01


def test_split_sizes_exact_and_disjoint(spark):
    df = fx.doc_clf(spark, SF01).select("doc_id", "quality")
    s = S.train_test_split(df, "quality", "doc_id", 0.8)
    got = {(r["quality"], r["split"]): r["n"] for r in
           s.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got[(0, "train")] == 46 and got[(1, "train")] == 273
    assert s.count() == 399 and s.select("doc_id").distinct().count() == 399


def test_bucketed_split_equals_single_bucket(spark, monkeypatch):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_orderpriority")
    a = S.train_test_split(o, "o_orderpriority", "o_orderkey", 0.7)
    monkeypatch.setattr(S, "TARGET_BUCKET_ROWS", 50)
    b = S.train_test_split(o, "o_orderpriority", "o_orderkey", 0.7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_balanced(spark, monkeypatch):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey", "o_orderpriority")
    f = S.kfold(o, "o_orderpriority", "o_orderkey", 5)
    per = f.groupBy("o_orderpriority", "fold").count().groupBy("o_orderpriority").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per)
    monkeypatch.setattr(S, "TARGET_BUCKET_ROWS", 64)
    g = S.kfold(o, "o_orderpriority", "o_orderkey", 5)
    assert f.exceptAll(g).count() == 0


def test_plain_split_when_class_has_one_row(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "id long, y string")
    s = S.train_test_split(df, "y", "id", 0.8)
    assert s.where("split = 'train'").count() == 8


def test_onehot_unseen_and_null(spark):
    df = spark.createDataFrame([(1, "x", "train"), (2, "y", "train"), (3, "z", "test"), (4, None, "test")],
                               "id long, c string, split string")
    out = E.onehot_fit(df, ["c"]).transform(df)
    rows = {r["id"]: (r["c_x"], r["c_y"]) for r in out.collect()}
    assert rows == {1: (1, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_ordinal_unseen_is_minus_one(spark):
    df = spark.createDataFrame([(1, "b", "train"), (2, "a", "train"), (3, "z", "test"), (4, None, "test")],
                               "id long, c string, split string")
    out = E.ordinal_fit(df, ["c"]).transform(df)
    assert {r["id"]: r["c"] for r in out.collect()} == {1: 1, 2: 0, 3: -1, 4: -1}


def test_standard_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (5.0, "test"), (7.0, "const")],
                               "x double, split string")
    sc = E.scaler_fit(df, "standard", ["x"])
    got = [r["x"] for r in sc.transform(df).orderBy("x").collect()]
    assert got[:2] == [-1.0, 1.0]
    mm = E.scaler_fit(spark.createDataFrame([(2.0, "train"), (2.0, "train")], "x double, split string"),
                      "minmax", ["x"])
    assert mm.params["x"] == (2.0, 1.0)


def test_ordinal_large_mapping_path(spark, monkeypatch):
    from sparkclf.operators import stats as ST
    df = spark.createDataFrame([(i, f"v{i % 37:03d}", "train" if i % 5 else "test") for i in range(400)],
                               "id long, c string, split string")
    a = {r["id"]: r["c"] for r in E.ordinal_fit(df, ["c"]).transform(df).collect()}
    monkeypatch.setattr(E, "BROADCAST_MAPPING_MAX", 3)
    monkeypatch.setattr(ST, "RANK_ROWS_PER_PARTITION", 5)
    b = {r["id"]: r["c"] for r in E.ordinal_fit(df, ["c"]).transform(df).collect()}
    assert a == b and sorted(set(a.values())) == list(range(37))


def test_allocation_and_guard(spark):
    def allocate(counts, n_draws):
        df = spark.createDataFrame([(str(k), v) for k, v in counts.items()], "__k string, __n long")
        return {r["__k"]: r["__alloc"] for r in S.allocate(df, sum(counts.values()), n_draws).collect()}
    assert allocate({0: 58, 1: 341}, 319) == {"0": 46, "1": 273}
    a = allocate({"a": 5, "b": 5, "c": 5}, 10)
    assert sum(a.values()) == 10 and a == {"a": 4, "b": 3, "c": 3}
    assert allocate({}, 0) == {}
    assert not S.can_stratify(10, 1, 10, 0.8)       # one class
    assert not S.can_stratify(11, 2, 1, 0.8)        # a class with one row
    assert not S.can_stratify(6, 3, 2, 0.9)         # test side cannot hold every class
    assert S.can_stratify(20, 2, 10, 0.8)


def test_allocation_ranked_in_range_partitions(spark, monkeypatch):
    """Many classes: the same allocation as in one task, with every remainder equal too."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(2, 40, 3000).tolist()
    for n_per in (sizes, [5] * 3000):
        df = spark.createDataFrame([(f"k{i:05d}", int(v)) for i, v in enumerate(n_per)], "__k string, __n long")
        n = sum(n_per)
        one = S.allocate(df, n, n * 7 // 10).collect()
        with monkeypatch.context() as m:
            m.setattr(S, "ONE_TASK_CLASSES", 400)
            many = S.allocate(df, n, n * 7 // 10)
            assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one))
            plan = many._jdf.queryExecution().toString()
            assert "rangepartitioning" in plan or "Scan ExistingRDD" in plan
        assert sum(r["__alloc"] for r in one) == n * 7 // 10


def test_split_of_a_million_classes(spark):
    df = spark.range(1_000_000).select((F.col("id") * 3 + 1).alias("__n"), F.concat(F.lit("c"), F.col("id")).alias("__k"))
    n = 3 * (1_000_000 * 999_999 // 2) + 1_000_000
    got = S.allocate(df, n, n // 2, 1_000_000).agg(F.sum("__alloc"), F.count("*")).first()
    assert tuple(got) == (n // 2, 1_000_000)


def test_sparse_onehot_is_one_schema_at_every_size(spark, monkeypatch):
    from sparkclf.models.common import feature_array
    from sparkclf.operators import stats as ST
    rows = [(i, f"v{i % 41:03d}" if i % 11 else None, ["x", "y", None][i % 3], "train" if i % 5 else "test") for i in range(600)]
    rows.append((600, "unseen", "unseen", "test"))
    df = spark.createDataFrame(rows, "id long, a string, b string, split string")
    want = {c: sorted({r[i] for r in rows if r[3] == "train" and r[i] is not None}) for i, c in ((1, "a"), (2, "b"))}
    seen = []
    for few, part in ((200_000, 100_000), (3, 100_000), (0, 7)):      # joined in place, both ways, through the shuffle
        monkeypatch.setattr(E, "BROADCAST_MAPPING_MAX", few)
        monkeypatch.setattr(ST, "RANK_ROWS_PER_PARTITION", part)
        m = E.onehot_fit(df, ["a", "b"], layout="sparse")
        out = m.transform(df)
        assert m.width == len(want["a"]) + len(want["b"])
        got = {r["id"]: (r["a_onehot"], r["b_onehot"]) for r in out.collect()}
        for i, a, b, _ in rows:
            for v, c, g in ((a, "a", got[i][0]), (b, "b", got[i][1])):
                assert g["size"] == len(want[c]) and g["index"] == (want[c].index(v) if v in want[c] else None)
        seen.append(out.schema)
        x = out.select("id", feature_array(out, ["a_onehot", "id", "b_onehot"]).alias("x")).collect()
        for r in x:
            hot = [g["index"] for g in got[r["id"]]]
            n = len(want["a"])
            assert len(r["x"]) == n + 1 + len(want["b"]) and r["x"][n] == r["id"]
            assert [i for i, v in enumerate(r["x"]) if v and i < n] == ([] if hot[0] is None else [hot[0]])
            assert [i - n - 1 for i, v in enumerate(r["x"]) if v and i > n] == ([] if hot[1] is None else [hot[1]])
    assert seen[0] == seen[1] == seen[2]


def test_onehot_of_nothing_and_of_too_many_columns(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, "train"), (2, "z", "test")], "id long, c string, split string")
    assert [r["c_onehot"] for r in E.onehot_fit(df, ["c"], layout="sparse").transform(df).orderBy("id").collect()] == [(0, None), (0, None)]
    assert E.onehot_fit(df, [], layout="sparse").transform(df).columns == df.columns
    assert E.ordinal_fit(df, ["c"]).transform(df).where("c = -1").count() == 2
    monkeypatch.setattr(E, "MAX_DUMMY_COLUMNS", 1)
    many = spark.createDataFrame([("a", "train"), ("b", "train")], "c string, split string")
    with pytest.raises(ValueError, match="sparse"):
        E.onehot_fit(many, ["c"])
