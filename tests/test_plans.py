"""Plan shape checks: no cartesian products, pruned scans, partial aggregation."""
from pyspark.sql import functions as F

from sparkclf.models import knn as K
from sparkclf.operators import metrics as M
from sparkclf.operators import profile as P
from sparkclf.operators import quality as Q
from sparkclf.operators import split as S
from sparkclf.plans import fixtures as fx
from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    emb = fx.emb_clf(spark, SF01)
    frames = [
        Q.detect_duplicates(fx.lineitem_dups(spark, SF01)),
        P.frequencies(orders, ["o_orderstatus", "o_orderpriority"]),
        S.train_test_split(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey"),
        S.kfold(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5),
        M.confusion_matrix(fx.preds_multi(spark, SF01).withColumn("model", F.lit("r"))),
        K.neighbours(emb.where("label < 5"), emb.where("label >= 5"), "embedding", "vec_id", "label", 3),
    ]
    for df in frames:
        p = _plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p[:500]


def test_scan_is_pruned_and_aggregation_is_partial(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    p = _plan(P.frequencies(li, ["l_returnflag"]))
    assert "l_returnflag" in p and "l_shipdate" not in p and "l_extendedprice" not in p
    assert "partial_count" in p
    d = _plan(Q.detect_duplicates(fx.lineitem_dups(spark, SF01)))
    assert "partial_count" in d and "l_shipdate" not in d
