import numpy as np
from pyspark.sql import functions as F

from sparkclf.operators import stats as S
from conftest import SF01


def _np_quantile(vals, p):
    return float(np.quantile(np.array(vals, dtype=float), p))


def test_histogram_refinement_equals_exact_percentile(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount")
    cols = li.columns
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    small = S.exact_quantiles(li, cols, probs)
    big = S.exact_quantiles(li, cols, probs, small_ndv=0, buckets=64)
    for key, v in small.items():
        assert abs(v - big[key]) <= 1e-9 * max(1.0, abs(v)), key


def test_quantiles_match_numpy_with_skew(spark):
    vals = [5.0] * 500 + [float(i) for i in range(100)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = S.exact_quantiles(df, ["x"], [0.1, 0.5, 0.99], small_ndv=0, buckets=16)
    for p in [0.1, 0.5, 0.99]:
        assert abs(got[("x", p)] - _np_quantile(vals, p)) < 1e-9


def test_modes_smallest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "s string")
    r = S.modes(df, ["s"]).first()
    assert (r["value"], r["count"]) == ("a", 2)


def test_distinct_counts_ignore_null(spark):
    df = spark.createDataFrame([("x", 1), ("y", None), (None, None)], "s string, t int")
    got = {r["column"]: r["n_unique"] for r in S.distinct_counts(df, ["s", "t"]).collect()}
    assert got == {"s": 2, "t": 1}


def test_quantiles_of_fifty_columns_take_two_scans(spark, monkeypatch):
    n = 30_000
    cols = [f"c{i}" for i in range(50)]
    df = spark.range(n).select(*[F.expr(f"double(conv(substring(md5(concat(id, ':', {i})), 1, 8), 16, 10)) / 7e6").alias(c)
                                 if i % 3 else F.expr(f"if(id % 3 = 0, 5.0D, exp(double(id % 997) / {i + 20}))").alias(c)
                                 for i, c in enumerate(cols)]).cache()
    scans = []
    monkeypatch.setattr(S, "FINAL_BRACKET_ROWS", 300)
    for name in ("_narrow", "_finish"):
        run = getattr(S, name)
        monkeypatch.setattr(S, name, lambda *a, run=run, name=name: scans.append(name) or run(*a))
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = S.exact_quantiles(df, cols, probs)
    monkeypatch.setattr(S, "SKETCHES_PER_SCAN", 400)
    got = S.exact_quantiles(df, cols, probs, small_ndv=0)
    assert scans == ["_narrow", "_finish"]
    assert all(abs(got[k] - v) <= 1e-9 * max(1.0, abs(v)) for k, v in want.items())


def test_quantiles_narrow_again_and_widen_a_missed_bracket(spark, monkeypatch):
    vals = [float(i * i % 4001) for i in range(4000)] + [7.0] * 2000 + [None, float("nan"), -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in vals], "x double").selectExpr("nanvl(x, null) AS x")
    real = [v for v in vals if v is not None and v == v]
    monkeypatch.setattr(S, "FINAL_BRACKET_ROWS", 3)
    probs = [0.0, 0.1, 0.3333, 0.5, 0.9, 1.0]
    for levels in (8, 64):
        got = S.exact_quantiles(df, ["x"], probs, small_ndv=0, buckets=levels)
        assert all(abs(got[("x", p)] - _np_quantile(real, p)) <= 1e-9 * abs(_np_quantile(real, p)) for p in probs)
    narrow, missed = S._narrow, []

    def off(*a):
        out = narrow(*a)
        if not missed:      # a sketch that is off: every bracket lies above the column
            missed.append(1)
            return {t: ((2e300, 3e300), 1) for t in out}
        return out

    monkeypatch.setattr(S, "_narrow", off)
    got = S.exact_quantiles(df, ["x"], probs, small_ndv=0, buckets=64)
    assert missed and all(abs(got[("x", p)] - _np_quantile(real, p)) <= 1e-9 * abs(_np_quantile(real, p)) for p in probs)
    empty = S.exact_quantiles(df.limit(0), ["x"], [0.5], small_ndv=-1)
    assert empty == {("x", 0.5): None}
