"""Print the physical plans of representative operators (for plan review).

    python tools/show_plans.py [/root/testdata/sf0.01] > PLANS.txt
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F
    from sparkclf.session import build_session
    from sparkclf.plans import fixtures as fx
    from sparkclf.operators import quality as Q, split as S, profile as P, stats as ST, metrics as M
    from sparkclf.models import knn as K
    spark = build_session("local[4]", shuffle_partitions=8)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    emb = fx.emb_clf(spark, d)
    shows = {
        "duplicates (row key, map-side partial count)": Q.detect_duplicates(fx.lineitem_dups(spark, d)),
        "distinct counts (compact keys, two-stage distinct)": ST.distinct_counts(fx.doc_clf(spark, d), ["text", "lang"]),
        "frequencies (column pruning to one column)": P.frequencies(orders, ["o_orderstatus"]),
        "stratified split (histogram, cut bucket, ranked bucket only)":
            S.train_test_split(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey"),
        "KNN neighbours (blocked cogroup, per-query top-k)":
            K.neighbours(emb.where("vec_id % 5 <> 0"), emb.where("vec_id % 5 = 0"), "embedding", "vec_id",
                         "label", 5, ("euclidean",)),
        "confusion counts": M.confusion_counts(fx.preds_multi(spark, d).withColumn("model", F.lit("r"))),
    }
    for title, df in shows.items():
        print(f"==== {title}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
