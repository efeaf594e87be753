"""Exact, seeded train/test splits and cross-validation folds.

Every row gets a deterministic draw ``u = md5('<seed>:<id>')`` (first 32 bits).
Within each class the ``alloc`` rows with the smallest (u, id) go to train.

Scale: ranking a whole class in one window would put a class holding a third
of the table into one task.  Instead the 32-bit draw is cut into 2^bits
buckets; a (class, bucket) histogram (bounded size) locates, per class, the
one bucket where the train allocation runs out.  Rows below it are train,
rows above it test, and only the rows inside that single bucket are ranked.
Folds use the same histogram for per-class offsets and rank inside each
(class, bucket), so every window partition is bucket-sized.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash32
from ..session import cut_lineage
from .stats import global_positions

_NULL_KEY = "\u0000<null>"
TARGET_BUCKET_ROWS = 20_000
ONE_TASK_CLASSES = 50_000     # more classes than this are ranked in range partitions
SENT_ROWS = 50_000            # histogram rows that are sent to the tasks instead of shuffling the table
COPIES_AT_ONCE = 10_000       # copies of an equal row that one step numbers


def class_key(label: str):
    return F.coalesce(F.col(label).cast("string"), F.lit(_NULL_KEY))


def _bits_for(max_class_rows: int) -> int:
    if max_class_rows <= TARGET_BUCKET_ROWS:
        return 0
    return min(20, int(math.ceil(math.log2(max_class_rows / TARGET_BUCKET_ROWS))))


def allocate(counts: DataFrame, n: int, n_draws: int, classes: int | None = None) -> DataFrame:
    """(__k, __alloc): ``n_draws`` of ``n`` rows spread over the classes of (__k, __n) proportionally:
    floor of the exact share, then one more for the largest remainders (ties -> class order).

    One row per class; no class list comes to the driver.  Many classes are ranked in range
    partitions of (remainder, class), so equal remainders spread over partitions too.
    """
    share = F.lit(float(n_draws)) * F.col("__n") / F.lit(float(max(n, 1)))
    c = counts.withColumn("__low", F.floor(share)).withColumn("__left", share - F.col("__low"))
    if classes is None:
        classes = counts.count()
    if classes <= ONE_TASK_CLASSES:
        c = c.withColumn("__more", F.lit(n_draws) - F.sum("__low").over(Window.partitionBy()))
        c = c.withColumn("__nth", F.row_number().over(Window.orderBy(F.desc("__left"), "__k")) - 1)
    else:
        c = cut_lineage(c.withColumn("__rank", F.struct((-F.col("__left")).alias("l"), "__k")))
        c = c.withColumn("__more", F.lit(n_draws - int(c.agg(F.sum("__low")).first()[0])))
        c = global_positions(c, "__rank", "__nth", classes, ONE_TASK_CLASSES)
    return c.select("__k", (F.col("__low") + (F.col("__nth") < F.col("__more")).cast("int")).cast("long").alias("__alloc"))


def _totals(counts: DataFrame) -> tuple[int, int, int, int]:
    """rows, classes, smallest and largest class."""
    r = counts.agg(F.sum("__n"), F.count(F.lit(1)), F.min("__n"), F.max("__n")).first()
    return tuple(int(x or 0) for x in r)


def can_stratify(n: int, n_classes: int, smallest: int, train_size: float) -> bool:
    n_train = int(math.floor(n * train_size))
    return n_classes >= 2 and smallest >= 2 and n_train >= n_classes and n - n_train >= n_classes


def _with_row_id(df: DataFrame) -> DataFrame:
    """A table without an id: equal rows are counted and told apart by a number, so a row's
    name is its content's digest and that number.  The count collapses copies before the shuffle."""
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__c"))
    # a few distinct rows may stand for very many: runs of copies are dealt to tasks before they are written out
    step = F.lit(COPIES_AT_ONCE).cast("long")
    g = g.withColumn("__digest", digest).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / step))))
    g = g.repartition(_shuffle_partitions(df))
    g = g.withColumn("__copy", F.explode(F.sequence(F.col("__run") * step + 1, F.least(F.col("__c"), (F.col("__run") + 1) * step))))
    return g.withColumn("__id", F.concat_ws(":", "__digest", F.col("__copy").cast("string"))).drop("__c", "__run", "__copy", "__digest")


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _meet(rows: DataFrame, small: DataFrame, keys: list, size: int, how: str) -> DataFrame:
    """Join with a table of at most ``size`` rows.  It is sent to the tasks while that is few: a shuffle by
    class would put a whole class into one task (Spark keeps to it where most partitions of ``small`` are empty)."""
    return rows.join(F.broadcast(small) if size <= SENT_ROWS else small, keys, how)


def _drawn(df: DataFrame, key, id_col: str, seed: int, bits: int) -> DataFrame:
    """With class ``__k``, draw ``__h`` and bucket ``__b``; a NULL id draws like any other value."""
    h = hash32(F.coalesce(F.col(id_col).cast("string"), F.lit(_NULL_KEY)), seed)
    return df.withColumn("__k", key).withColumn("__h", h).withColumn(
        "__b", F.shiftright(F.col("__h"), 32 - bits) if bits else F.lit(0))


def _class_sizes(df: DataFrame, key) -> DataFrame:
    return df.groupBy(key.alias("__k")).agg(F.count(F.lit(1)).alias("__n"))


def train_test_split(df: DataFrame, label: str | None, id_col: str | None, train_size: float = 0.8,
                     seed: int = 42, stratify: bool = True) -> DataFrame:
    """Add ``split`` ('train' / 'test').  Stratified on ``label`` when every class
    has at least two rows (and both sides can hold every class), else plain.

    ``id_col`` names the row in the seeded draw (rows that share it draw alike and
    are told apart arbitrarily); None derives a name from the row's content.
    """
    cols = df.columns + ["split"]
    if id_col is None:
        df, id_col = _with_row_id(df), "__id"
    key = class_key(label) if label else F.lit("all")
    counts = _class_sizes(df, key)
    n, n_classes, smallest, largest = _totals(counts)
    n_train = int(math.floor(n * float(train_size)))
    if not (stratify and label and can_stratify(n, n_classes, smallest, train_size)):
        key = F.lit("all")
        counts, largest, n_classes = _class_sizes(df, key), n, 1
    bits = _bits_for(largest)
    base = _drawn(df, key, id_col, seed, bits)
    hist = base.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__k").orderBy("__b")
    cut = (hist.withColumn("__cum", F.sum("__n").over(w)).join(allocate(counts, n, n_train, n_classes), "__k")
           .where((F.col("__cum") - F.col("__n") < F.col("__alloc")) & (F.col("__cum") >= F.col("__alloc")))
           .select("__k", F.col("__b").alias("__cut"), (F.col("__alloc") - F.col("__cum") + F.col("__n"))
                   .alias("__need")))
    j = _meet(base, cut, ["__k"], n_classes, "left")
    edge = F.coalesce(F.col("__b") == F.col("__cut"), F.lit(False))
    outside = j.where(~edge).withColumn(
        "split", F.when(F.col("__b") < F.col("__cut"), "train").otherwise("test"))
    rw = Window.partitionBy("__k", "__b").orderBy("__h", id_col)
    inside = j.where(edge).withColumn("split", F.when(F.row_number().over(rw) <= F.col("__need"), "train")
                                      .otherwise("test"))
    return outside.select(*cols).unionByName(inside.select(*cols))


def kfold(df: DataFrame, label: str | None, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1: shuffled (seeded), stratified round-robin by the
    rank of (u, id) within the class, so every class is spread over the folds
    within one row."""
    if not 2 <= k:
        raise ValueError("k must be >= 2")
    key = class_key(label) if label else F.lit("all")
    _, n_classes, _, largest = _totals(_class_sizes(df, key))
    bits = _bits_for(largest)
    base = _drawn(df, key, id_col, seed + 1, bits)
    hist = base.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = hist.select("__k", "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    rw = Window.partitionBy("__k", "__b").orderBy("__h", id_col)
    ranked = _meet(base, off, ["__k", "__b"], n_classes << bits, "inner").withColumn("__r", F.col("__off") + F.row_number().over(rw) - 1)
    return ranked.withColumn("fold", (F.col("__r") % F.lit(k)).cast("int")).select(*df.columns, "fold")
