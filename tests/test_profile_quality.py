import math

from pyspark.sql import functions as F

from sparkclf.operators import profile as P
from sparkclf.operators import quality as Q
from sparkclf.plans import fixtures as fx
from conftest import SF01


def test_golden_health_score(spark):
    rep = Q.detect_all(fx.doc_clf(spark, SF01), "quality")
    assert rep.score == 77
    assert rep.breakdown["Outliers"] == 3 and rep.breakdown["Class Imbalance"] == 15
    assert rep.breakdown["High Cardinality"] == 5
    assert rep.outliers == {"n_chars": 33}


def test_edge_columns(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.0, float("nan")), (None, 1.0, 5.0)],
                               "a double, c double, m double")
    from sparkclf.functions import normalize_missing
    df = normalize_missing(df)
    iqr = {r["column"]: r["outlier_count"] for r in P.outliers_iqr(df).collect()}
    assert iqr == {"a": 0, "c": 0, "m": 0}
    z = {r["column"]: r["outlier_count"] for r in P.outliers_zscore(df).collect()}
    assert z == {"a": 0, "c": 0, "m": 0}
    const = {r["column"] for r in Q.detect_constant(df).collect()}
    assert const == {"a", "c"}
    miss = {r["column"]: r["missing_count"] for r in P.missing_summary(df).collect()}
    assert miss == {"a": 3, "c": 0, "m": 1}


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert P.outliers_zscore(one).first()["outlier_count"] == 0
    empty = spark.createDataFrame([], "a double, y string")
    assert Q.detect_duplicates(empty).first()["percentage"] == 0.0
    imb = Q.detect_class_imbalance(empty, "y").first()
    assert imb["ratio"] == 1.0 and not imb["has_issue"]


def test_one_class_target(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "y int")
    assert Q.detect_class_imbalance(df, "y").first()["ratio"] == 1.0


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 1.0), (3.0, 2.0, 2.0)], "x double, k double, y double")
    got = {(r["col_x"], r["col_y"]): r["corr"] for r in P.correlation(df).collect()}
    assert got[("x", "k")] is None and got[("k", "k")] is None
    assert got[("x", "x")] == 1.0
    assert math.isclose(got[("x", "y")], -0.5, abs_tol=1e-12)


def test_histogram_counts_all_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    h = P.histogram(df).collect()
    assert sum(r["count"] for r in h) == 100 and len(h) == math.ceil(math.log2(100)) + 1


def test_coercion_threshold(spark):
    half = spark.createDataFrame([("1",), ("2",), ("a",), ("b",)], "s string")
    assert dict(half.dtypes)["s"] == "string"
    assert dict(P.clean_and_coerce(half, 0.5).dtypes)["s"] == "double"
    assert dict(P.clean_and_coerce(half, 0.51).dtypes)["s"] == "string"


def test_correlation_paths_agree(spark, monkeypatch):
    from conftest import SF01
    from sparkclf.plans import fixtures as fx2
    li = fx2.lineitem_num(spark, SF01)
    a = {(r["col_x"], r["col_y"]): r["corr"] for r in P.correlation(li).collect()}
    monkeypatch.setattr(P, "GRAM_ROWS", 2)
    monkeypatch.setattr(P, "GRAM_GROUPS", 1)
    b = {(r["col_x"], r["col_y"]): r["corr"] for r in P.correlation(li).collect()}
    monkeypatch.setattr(P, "GRAM_CELLS", 1)                 # a scan per two matrix rows
    c = {(r["col_x"], r["col_y"]): r["corr"] for r in P.correlation(li.repartition(7)).collect()}
    assert a.keys() == b.keys() == c.keys()
    for k in a:
        assert abs(a[k] - b[k]) < 1e-9 and abs(a[k] - c[k]) < 1e-9, k


def test_correlation_of_a_wide_table_with_nulls(spark, monkeypatch):
    import numpy as np
    rng = np.random.RandomState(2)
    x = rng.normal(size=(120, 200)).cumsum(axis=1) * 10.0 ** rng.randint(-3, 6, 200) + 1e6
    x[rng.random(size=x.shape) < 0.3] = np.nan
    x[:, 7], x[:, 8], x[:, 9] = np.nan, 0.1, np.where(rng.random(120) < 0.5, np.nan, 3.3)
    x[:60, 10], x[60:, 11] = np.nan, np.nan                 # never known together
    cols = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([[None if v != v else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r["col_x"], r["col_y"]): r["corr"] for r in P.correlation(df).collect()}
    assert len(got) == 200 * 200
    for i in range(200):
        for j in range(i, 200, 7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            want = None
            if both.any() and len(set(u)) > 1 and len(set(v)) > 1:
                want = np.corrcoef(u, v)[0, 1]
            for g in (got[(f"c{i}", f"c{j}")], got[(f"c{j}", f"c{i}")]):
                assert (g is None) == (want is None) and (g is None or abs(g - want) < 1e-6), (i, j, g, want)
    plan = P.correlation(df)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Scan") == 1
    assert all(r["corr"] is None for r in P.correlation(df.select("c1", "c2").limit(0)).collect())


def test_smallest_values_behind_repeated_ones(spark):
    rows = [("",)] * 500 + [("aa",)] * 300 + [(None,)] * 50 + [(f"v{i:03d} é\U0001F600",) for i in range(200)]
    df = spark.createDataFrame(rows, "s string").repartition(5)
    values = sorted({r[0] for r in rows if r[0] is not None})
    for k in (1, 3, 10):
        assert P.smallest_values(df, "s", k) == values[:k]
    assert P.smallest_values(df.where("s = 'aa'"), "s", 4) == ["aa"] and P.smallest_values(df.limit(0), "s", 4) == []
    r = P.non_numeric_report(df, 3).first()
    assert (r["column"], r["non_numeric_count"], r["sample_values"]) == ("s", 1000, values[:3])


def test_detectors_read_the_source_once(spark):
    """The source is evaluated once for all detectors; long texts, nested and null-typed columns and odd names keep their counts."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = [(i % 50, "x" * 100 + str(i % 45), ["a", "b"][i % 2], None, bytes([i % 3]), [i % 2], i % 2) for i in range(100)]
    schema = "`a b` long, long_text string, short string, gone string, raw binary, list array<int>, label int"
    src = spark.createDataFrame(rows, schema).repartition(2).mapInArrow(count, schema)
    rep = Q.detect_all(src.withColumn("void", F.lit(None)), "label")
    assert seen.value == 100 and rep.rows == 100
    assert rep.missing == {"gone": 100.0, "void": 100.0} and set(rep.constant) == {"gone", "void"}
    assert rep.dup_count == 0 and rep.high_cardinality == {}
    assert sorted(map(tuple, rep.distribution.collect())) == [("0", 50), ("1", 50)]
    twice = Q.detect_all(spark.createDataFrame(rows + rows, schema), "label")
    assert twice.dup_count == 100 and twice.dup_issue
    wide = Q.detect_all(spark.createDataFrame([("y" * 40 + str(i), "t" * 30) for i in range(60)], "t string, label string"), "label")
    assert wide.high_cardinality == {"t": 60} and wide.distribution.first()["class"] == "t" * 30


def test_kde_equals_the_full_sum_and_leaves_gaps_empty(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 400), np.repeat([2.5, -1.0], 150), [1e6]])      # a far value: most points meet nothing
    near = vals[:-1]
    df = spark.createDataFrame([(float(v), float(round(w)), float(w)) for v, w in zip(vals, np.append(near, 0.5))],
                               "far double, few double, near double")
    got = {(r["column"], r["point"]): (r["x"], r["density"]) for r in P.kde(df, cut=3.0).collect()}
    assert len(got) == 600
    for c, data in (("far", vals), ("few", np.round(np.append(near, 0.5))), ("near", np.append(near, 0.5))):
        bw = data.std(ddof=1) * len(data) ** -0.2
        for p in range(200):
            x, dens = got[(c, p)]
            full = np.exp(-0.5 * ((x - data) / bw) ** 2).sum() / (len(data) * bw * math.sqrt(2 * math.pi))
            assert abs(full - dens) <= math.exp(-0.5 * 8.6 ** 2) / (bw * math.sqrt(2 * math.pi)) + 1e-12 * full
    assert P.kde(spark.createDataFrame([(1.0, float("inf")), (1.0, 2.0)], "flat double, inf double")).count() == 0


def test_kde_keeps_values_on_executors(spark):
    df = spark.range(100).selectExpr("double(id * id) AS x")
    assert "MapInPandas" not in P.kde(df)._jdf.queryExecution().toString()
