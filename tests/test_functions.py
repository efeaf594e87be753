from pyspark.sql import functions as F

from sparkclf.functions import clean_text, normalize_missing, num, uniform


def test_number_like_text(spark):
    vals = ["1", " 2 ", "1,5", "1e3", "1d", "1_0", "nan", "", None, "inf", "+.5", "-3."]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(num(clean_text("s"))).collect()]
    assert got == [1.0, 2.0, 1.5, 1000.0, None, None, None, None, None, None, 0.5, -3.0]


def test_clean_text_whitespace(spark):
    df = spark.createDataFrame([("  a \t\n b  ",), ("nan",), ("x,y",)], "s string")
    assert [r[0] for r in df.select(clean_text("s")).collect()] == ["a b", None, "x.y"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")
    out = normalize_missing(df)
    assert out.where(F.col("a").isNull()).count() == 2


def test_uniform_matches_md5_prefix(spark):
    import hashlib
    df = spark.range(20).select(F.col("id"), uniform("id").alias("u"))
    for r in df.collect():
        h = int(hashlib.md5(f"42:{r['id']}".encode()).hexdigest()[:8], 16)
        assert abs(r["u"] - h / 2 ** 32) < 1e-15
