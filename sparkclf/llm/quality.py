"""Quality rules with adaptive thresholds (native).

Every measure of a text is computed inside its row from whole-text array and string
functions, so texts are never shuffled.  Words in repeated 3-word windows: each
window's 64-bit hash gives its upper bits and the window's place its lower bits to
one long; sorting these longs brings equal windows together.

Thresholds replace fixed cutoffs: rates are integers per 10,000, and a quantile
sketch per (lang, source, measure) is the count per bucket of 1.6 % relative width
(exact below 128).  Sketches merge by adding counts; a group with fewer than
``min_group`` documents uses its language's merged sketch, a small language the
one of all documents.  An upper fence is median + ``spread`` * (median - q10) + slack
(the lower quantiles, as junk sits in the upper tail); word length also has a lower fence.
The thresholds are joined to the documents and filter them.

Defined cases: null and empty texts have no words and fail the base rule; null
languages and sources are groups of their own; repeated rows get equal rows; an
empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import GAP, Stash, pick

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Slack of each measure's fence, in the measure's own unit (rates per 10,000; word length in hundredths).
SLACK = {"symbols": 500, "dup_lines": 5000, "repeats": 4500, "marks": 3000, "word_length": 300}
TWO_SIDED = {"word_length"}
MIN_GROUP, SPREAD = 200, 6


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


def measures(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", id_col="doc_id") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks)."""
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("body", F.btrim("text", F.lit(SPACES)))
    d = d.withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", GAP)))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    n = F.size("words")
    d = d.withColumn("bits", F.length(F.bin(n.cast("long"))))
    d = d.withColumn("low", (F.expr("shiftleft(1L, bits)") - 1).cast("long"))
    trio = F.arrays_zip(F.slice("words", 1, F.greatest(n - 2, F.lit(0))).alias("a"),
                        F.slice("words", 2, F.greatest(n - 2, F.lit(0))).alias("b"),
                        F.slice("words", 3, F.greatest(n - 2, F.lit(0))).alias("c"))
    packed = F.transform(trio, lambda x, i: F.xxhash64(x).bitwiseAND(F.bitwise_not(F.col("low"))).bitwiseOR(i.cast("long")))
    d = d.withColumn("keys", F.sort_array(packed))
    m = F.size("keys")
    side = F.arrays_zip(F.col("keys").alias("k"), F.concat(F.array(F.lit(None).cast("long")), F.slice("keys", 1, F.greatest(m - 1, F.lit(0)))).alias("p"),
                        F.concat(F.slice("keys", 2, F.greatest(m - 1, F.lit(0))), F.array(F.lit(None).cast("long"))).alias("q"))

    def same(x, y):
        return F.coalesce(x.bitwiseXOR(y) <= F.col("low"), F.lit(False)) & F.coalesce(x.bitwiseXOR(y) >= 0, F.lit(False))

    again = F.filter(side, lambda x: same(x["k"], x["p"]) | same(x["k"], x["q"]))
    d = d.withColumn("at", F.sort_array(F.transform(again, lambda x: x["k"].bitwiseAND(F.col("low")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    covered = F.aggregate("at", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")))
    return d.select("doc_id", "lang", "source", n.cast("long").alias("n_words"),
                    F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                    _count(F.col("text"), SYMBOLS).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    covered["n"].alias("n_repeat_words"), _count(F.col("text"), "!?").alias("n_marks"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Integer measures that the fences bound."""
    def per(a, b, scale):
        return F.expr(f"CASE WHEN {b} > 0 THEN ({scale} * {a}) div {b} ELSE 0 END")
    return {"symbols": per("n_symbols", "word_chars", 10000), "dup_lines": per("n_dup_lines", "n_lines", 10000),
            "repeats": per("n_repeat_words", "n_words", 10000), "marks": per("n_marks", "n_words", 10000),
            "word_length": per("word_chars", "n_words", 100)}


def bucket(v: str) -> Column:
    """Sketch bucket of a non-negative integer column: exact below 128, then its top seven bits."""
    return F.expr(f"CASE WHEN {v} < 128 THEN {v} ELSE 64L * (length(bin({v})) - 7) + shiftright({v}, length(bin({v})) - 7) END")


def value(b: str) -> Column:
    """Smallest value of a bucket."""
    return F.expr(f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft(64L + ({b} - 128) % 64, cast(({b} - 128) div 64 + 1 AS int)) END")


def sketches(m: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): counts of documents that pass the base rule."""
    r = rates()
    long = (m.filter(~base_failed()).select("lang", "source", F.explode(F.create_map(*[x for k, c in r.items() for x in (F.lit(k), c.cast("long"))])).alias("measure", "v")))
    return long.groupBy("lang", "source", "measure", bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by.., measure, size, q10, q50, q90) of a merged sketch; a window sees the buckets of one sketch."""
    w = W.partitionBy(*by, "measure")
    c = sketch.withColumn("size", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    q = [F.min(F.when(F.col("upto") * 10 >= F.col("size") * k, F.col("bucket"))).alias(f"b{k}") for k in (1, 5, 9)]
    return (c.groupBy(*by, "measure").agg(F.first("size").alias("size"), *q)
             .select(*by, "measure", "size", value("b1").alias("q10"), value("b5").alias("q50"), value("b9").alias("q90")))


def fences(sketch: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP, slack: dict = SLACK) -> DataFrame:
    """(lang, source, measure, low, high), from the group's own sketch or the merged one it falls back to."""
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(merged(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.struct("size", "q10", "q50", "q90").alias("by_lang"))
    every = quantiles(merged(sketch, []), []).select(F.col("measure").alias("em"), F.struct("size", "q10", "q50", "q90").alias("by_all"))
    j = (own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm")))
            .join(every, F.col("measure") == F.col("em")))
    use = F.when(F.col("size") >= min_group, F.struct("size", "q10", "q50", "q90")).when(F.col("by_lang")["size"] >= min_group, F.col("by_lang")).otherwise(F.col("by_all"))
    j = j.withColumn("use", use)
    room = F.element_at(F.create_map(*[F.lit(x) for k, v in slack.items() for x in (k, v)]), F.col("measure"))
    step = spread * (F.col("use.q50") - F.col("use.q10")) + room
    return j.select("lang", "source", "measure", (F.col("use.q50") + step).alias("high"),
                    F.when(F.col("measure").isin(*TWO_SIDED), F.col("use.q50") - step).alias("low"))


def judge(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", id_col="doc_id", **fence_args) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``, one row per document."""
    stash = Stash(docs.sparkSession, "quality")
    m = stash.put(measures(docs, text_col, lang_col, source_col, id_col).withColumn("base_failed", base_failed()), "measures")
    f = fences(stash.put(sketches(m), "sketch"), **fence_args)
    wide = f.groupBy(F.col("lang").alias("fl"), F.col("source").alias("fs")).agg(
        *[F.max(F.when(F.col("measure") == k, F.col("high"))).alias(f"hi_{k}") for k in SLACK],
        *[F.max(F.when(F.col("measure") == k, F.col("low"))).alias(f"lo_{k}") for k in TWO_SIDED])
    wide = stash.put(wide, "fences")
    ok = ~F.col("base_failed")
    for k, c in rates().items():
        ok = ok & (c <= F.coalesce(F.col(f"hi_{k}"), c))
        if k in TWO_SIDED:
            ok = ok & (c >= F.coalesce(F.col(f"lo_{k}"), c))
    return (m.join(wide, F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs")), "left")
             .withColumn("kept", ok).select(*m.columns, "kept"))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` that the rules keep (rows of one id are kept together)."""
    id_col = kw.get("id_col", "doc_id")
    good = judge(docs, **kw).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(good, docs[id_col].eqNullSafe(good["_id"]), "left_semi")
