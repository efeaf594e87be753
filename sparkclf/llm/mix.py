"""Mixing sources to target weights by hash-threshold histograms (native).

Each source gets a token target by water-filling: weights share the budget, a
target stops at ``cap`` times its source, the excess is reshared.  A source whose
target is r times its size is taken floor(r) times whole; the rest is met by the
documents whose 60-bit hash lies below a threshold.  The threshold comes from
histograms: tokens are summed by (source, top 12 hash bits), the bucket in which
the budget ends is found, and only that bucket is refined by the next 12 bits, at
most five times.  Nothing is sorted; documents taken at a smaller budget are also
taken at a larger one.

The only window without a partition is over one row per source; windows per
source see at most 4096 buckets.  A source that holds a third of all rows is
pre-aggregated like every other.

Defined cases: null text has size 0; sources are ordered by code point, null
last, null being a source of its own; a null id is hashed by its text; rows with
equal hashes are taken together; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Stash, has_rows, n_words, pick

HASH_BITS, STEP = 60, 12


def source_targets(sized: DataFrame, weights=(1, 2, 3), cap: int = 3, budget: int | None = None) -> DataFrame:
    """(source, source_size, target, full, rest) from (source, size) rows.

    Water-filling in closed form: in order of cap * size / weight, the level is that
    of the first source which stays below its cap.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = (s.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                             ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
          .withColumn("limit", F.lit(cap) * F.col("source_size"))
          .withColumn("key", F.col("limit") / F.col("weight")))
    every = W.partitionBy()
    below = W.orderBy("key", "source").rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum("source_size").over(every) if budget is None else F.lit(int(budget)))
          .withColumn("capped", F.coalesce(F.sum("limit").over(below), F.lit(0)))
          .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
          .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open")))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("key"), F.struct("key", "source", "level")))
                     .over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("limit") < F.col("weight") * F.col("level")),
                    F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level"))
    s = s.withColumn("target", target)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (s.withColumn("full", F.least(full, F.lit(cap)).cast("long"))
             .withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("source_size"), F.lit(0.0)))
             .select("source", "source_size", "target", "full", "rest"))


def _boundary(rows: DataFrame, bits: int) -> DataFrame:
    """The bucket of ``bits`` remaining bits in which each source's rest ends.

    rows: (source, h, size, rest, before); before is what lower buckets hold.
    """
    hist = (rows.groupBy("source", F.shiftright("h", bits).alias("bucket"))
                .agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"),
                     F.first("rest").alias("rest"), F.first("before").alias("before")))
    w = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.col("before") + F.sum("size").over(w))
    return (cum.filter(F.col("upto") > F.col("rest"))
               .groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "lo", "hi", "rest")).alias("x"))
               .select("source", "x.bucket", (F.col("x.upto") - F.col("x.size")).alias("before"),
                       F.col("x.size").alias("size"), "x.lo", "x.hi", "x.rest"))


def thresholds(sized: DataFrame, targets: DataFrame, stash: Stash) -> DataFrame:
    """(source, threshold): hashes below it are taken once more.  Sources that need none are absent."""
    need = targets.filter("rest > 0").select(F.col("source").alias("s"), "rest")
    rows = (sized.filter("size > 0").join(need, F.col("source").eqNullSafe(F.col("s")))
                 .select("source", "h", "size", "rest", F.lit(0).cast("long").alias("before")))
    found = None
    for bits in range(HASH_BITS - STEP, -1, -STEP):
        b = stash.put(_boundary(rows, bits), f"bucket{bits}")
        single = F.col("lo") == F.col("hi")
        last = b.filter(single)
        found = last if found is None else found.unionByName(last)
        if not has_rows(b.filter(~single)):
            break
        deeper = b.filter(~single).select(F.col("source").alias("s"), "bucket", "rest", "before")
        rows = (sized.filter("size > 0")
                     .join(deeper, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", bits) == F.col("bucket")))
                     .select("source", "h", "size", "rest", "before"))
    nearer = F.col("before") + F.col("size") - F.col("rest") < F.col("rest") - F.col("before")
    return found.select("source", F.when(nearer, F.col("lo") + 1).otherwise(F.col("lo")).alias("threshold"))


def _hash(id_col, text_col):
    key = F.coalesce(id_col.cast("string"), text_col, F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _plan(docs: DataFrame, id_col, text_col, source_col, weights, cap, budget) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of all documents, and (s, source_size, target, full, threshold) per source."""
    stash = Stash(docs.sparkSession, "mix")
    d = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = stash.put(d.select("doc_id", "source", n_words("text").alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("h")), "sized")
    targets = stash.put(source_targets(sized, weights, cap, budget), "targets")
    cut = thresholds(sized, targets, stash).select(F.col("source").alias("cs"), "threshold")
    plan = (targets.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
                   .select(F.col("source").alias("s"), "source_size", "target", "full", "threshold"))
    return sized, stash.put(plan, "plan")


def _times(h, cap: int):
    more = F.coalesce((h < F.col("threshold")).cast("long"), F.lit(0))
    return F.least(F.col("full") + more, F.lit(cap)).cast("long")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3),
        cap: int = 3, budget: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken), one row per input row.

    ``times`` is how often the mix takes the document, ``taken`` = times * size.
    ``budget`` is the mix's number of words (default: that of all documents).
    """
    sized, plan = _plan(docs, id_col, text_col, source_col, weights, cap, budget)
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
                 .withColumn("times", _times(F.col("h"), cap))
                 .select("doc_id", "source", "size", "source_size", "target", "times",
                         (F.col("times") * F.col("size")).alias("taken")))


def apply_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3),
              cap: int = 3, budget: int | None = None) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.

    Texts are joined only with the per-source plan, so they are not shuffled where it is small.
    """
    _, plan = _plan(docs, id_col, text_col, source_col, weights, cap, budget)
    j = docs.join(plan, docs[source_col].eqNullSafe(plan["s"]))
    j = j.withColumn("_times", _times(_hash(docs[id_col], docs[text_col]), cap)).filter("_times > 0")
    return (j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
             .select(*[docs[c] for c in docs.columns]))
