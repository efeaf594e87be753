"""Helpers shared by the training-data operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a maximal run without the six ASCII white-space characters (fixed by the query contracts).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def n_words(text) -> Column:
    """Number of words of a text column; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in Arrow batches of some ``BATCH_BYTES``, unless the session has a limit of its own.

    Spark's own limit is 64 MB, of which the JVM and the worker of each running task hold several copies.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Stash:
    """Written intermediate tables in the shared folder of ``spark.checkpoint.dir``.

    ``put`` writes a table once and reads it back, which cuts the lineage: a lost
    executor costs only the tasks that read it.  ``drop`` removes tables that no
    later result reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.spark, self.root, self.paths = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        schema = df.schema
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            p.getFileSystem(conf).delete(p, True)


def pick(df: DataFrame, **cols) -> DataFrame:
    """Only the named columns under fixed names, so extra columns never clash.

    A column may be absent (None): it becomes a null string.
    """
    return df.select(*[(df[c] if c is not None else F.lit(None).cast("string")).alias(k) for k, c in cols.items()])


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


BITMAP_BITS = 1 << 25


def may_be_in(df: DataFrame, mark: str, members: DataFrame, member_mark: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false only where no row of ``members`` has this mark.

    The marks of ``members`` set bits of a bitmap of 2^25 bits, 4 MB at most whatever their
    number, which is broadcast.  It keeps rows that cannot match out of a shuffle; a bitmap
    that has filled up keeps out none.
    """
    def slot(m):
        return F.pmod(F.col(m), F.lit(BITMAP_BITS))
    bits = (members.select(slot(member_mark).alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")))
    d = df.withColumn("_slot", slot(mark)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    d = d.join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(bitmap_bit_position(_slot) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (F.bitmap_bit_position("_slot") % 8).cast("int"))
    return d.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_slot", "_bucket", "_bits")
