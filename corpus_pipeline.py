"""Corpus pipeline: documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its result is
written as Parquet and read again as the next one's documents.  All but the last return
the columns of ``documents``.  The stages call the operators of ``sparkclf.llm`` and keep
their defined cases (nulls, empty and very long texts, ties, repeated rows, empty tables).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclf.llm import gam, linedup, mix, ngram_join, pack
from sparkclf.llm.common import Stash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labelled ones of them, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = gam.score(docs, gam.train(docs, labels), carry=tuple(docs.columns))
    return scored.filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more go; so do documents of which nothing is left."""
    out = linedup.dedup_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a word-shingle similarity of 0.8 or more, that with the smallest id stays."""
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once, or up to three times."""
    return mix.apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return pack.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("source mix", source_mix), ("best-fit packing", packing)]

#: The first stage is a fitted model and the last a heuristic packing: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stash, docs = Stash(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
