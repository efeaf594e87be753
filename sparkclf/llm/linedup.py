"""Line dedup by a suffix array over line-ID sequences (native).

A document is the sequence of its lines that hold a word.  A line is deleted if it
lies in a run of consecutive lines with at least ``min_words`` words that also occurs,
line for line, starting earlier (by id, then line): maximal repeated runs keep their
first copy and lose the later ones.

1. Lines that occur once end every repeated run, so only segments of consecutive
   repeated lines with enough words go on, as rows (document, line, rank).
2. Prefix doubling: in round k suffixes that tie on 2^k lines are told apart by the
   rank of the suffix 2^k lines further.  Ranks are positions in the suffix order,
   from counts per (rank, next rank): no rows of one rank are ever gathered in a task,
   prefix sums run over 2^17 ranks at a time.  Suffixes that are alike up to their
   segment's end stay one class, whose first member stands for it.  Segments without
   ties leave the rounds.
3. Longest common prefixes of neighbours in suffix order come from the ranks that
   both had in each round, halving the step.
4. LCP intervals: a suffix is settled by the neighbour with the longer common prefix
   if that one starts earlier; that length is its longest earlier occurrence.  Settled
   suffixes leave the list, whose next neighbours get the smallest prefix between them,
   until only first copies are left.  Chains in which every later document repeats
   and extends the one before take one round per document.

Everything is window, join and aggregate functions over rows of ids; texts travel once,
when the deletions are applied.

Defined cases: null and empty texts have no lines; lines without words are never
compared or deleted; an id of null comes first; rows of one id are told apart by their
text, and of wholly equal rows the first is kept; an empty table gives an empty result.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Stash, has_rows, may_be_in

MIN_WORDS, RADIX = 50, 17
SPACES = " \t\n\x0b\f\r"
KEY = ["id", "dig"]


def _key_columns(docs: DataFrame, id_col: str, text_col: str):
    """id without null, and a digest that tells texts of one id apart."""
    number = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    none = F.lit(-(1 << 63)).cast("long") if number else F.lit("")
    return F.coalesce(docs[id_col].cast("long" if number else "string"), none), F.xxhash64(docs[text_col])


def worded(text):
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def line_rows(docs: DataFrame, stash: Stash) -> DataFrame:
    """(id, dig, s, w, h1, h2): the lines with a word, numbered, with their words and two hashes."""
    lines = docs.select(*KEY, F.posexplode(worded(F.col("text"))).alias("s", "line"))
    return stash.put(lines.select(*KEY, "s", F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"),
                                  F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")


def segments(lines: DataFrame, stash: Stash, min_words: int) -> DataFrame:
    """(id, dig, seg, s, r, rem, m): lines of segments of repeated lines; r = rank of the line,
    rem = lines to the segment's end, m = lines until ``min_words`` words are reached (null: never)."""
    many = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").withColumn("top", F.shiftrightunsigned("h1", 48))
    base = many.groupBy("top").agg(F.sum("c").alias("n"))     # at most 2^16 rows
    before = W.orderBy("top").rowsBetween(W.unboundedPreceding, -1)
    base = base.select("top", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("top").orderBy("h1", "h2").rowsBetween(W.unboundedPreceding, -1)
    ranked = many.join(base, "top").select("h1", "h2", (F.lit(1) + F.col("base") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("r"))
    doc = W.partitionBy(*KEY).orderBy("s")
    t = lines.join(ranked, ["h1", "h2"]).select(*KEY, "s", "w", "r").withColumn("was", F.lag("s").over(doc))
    t = t.filter("was IS NULL OR was <> s").withColumn("seg", F.col("s") - F.row_number().over(doc))   # equal rows count once
    seg = W.partitionBy(*KEY, "seg")
    t = (t.withColumn("words", F.sum("w").over(seg)).filter(F.col("words") >= min_words)
          .withColumn("upto", F.sum("w").over(seg.orderBy("s"))).withColumn("rem", F.max("s").over(seg) - F.col("s") + 1))
    reach = seg.orderBy(F.col("upto") - F.col("w")).rangeBetween(W.currentRow, min_words - 1)
    t = t.withColumn("m", F.when(F.col("words") - F.col("upto") + F.col("w") >= min_words, F.count("*").over(reach)))
    return stash.put(t.select(*KEY, "seg", "s", "r", "rem", "m"), "segments")


def suffix_ranks(seg: DataFrame, stash: Stash) -> DataFrame:
    """(id, dig, seg, s, r, rem, m, hist, state): suffix ranks; hist = ranks while tied, one per round;
    state 1: in the suffix array, 2: equal to an earlier suffix up to the segment's end."""
    live = seg.withColumns({"tied": F.lit(True), "hist": F.array("r"), "state": F.lit(0)})
    done, k = [], 0
    while True:
        w = W.partitionBy(*KEY, "seg")
        x = live.withColumns({"r2": F.coalesce(F.lead("r", 1 << k).over(w.orderBy("s")), F.lit(0)), "alive": F.max("tied").over(w)})
        x = stash.put(x, f"round{k}")
        done.append(x.filter("NOT alive").drop("r2", "alive", "tied"))
        if not has_rows(x.filter("alive")):
            ranks = stash.put(reduce(DataFrame.unionByName, done), "ranks")
            stash.drop(*[f"round{i}" for i in range(k + 1)])
            return ranks
        tied = x.filter("alive AND tied").drop("alive")
        g = (tied.groupBy("r", "r2").agg(F.count("*").alias("n"), F.min(F.struct("id", "dig", "s")).alias("first"))
                 .withColumn("b", F.shiftright("r2", RADIX)))
        before = W.partitionBy("r").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        coarse = (g.groupBy("r", "b").agg(F.sum("n").alias("c"))
                   .select("r", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off")))
        inside = W.partitionBy("r", "b").orderBy("r2").rowsBetween(W.unboundedPreceding, -1)
        g = (g.join(coarse, ["r", "b"])
              .select("r", "r2", "n", "first", (F.col("r") + F.col("off") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("nr")))
        ended, alone = F.col("r2") == 0, F.col("n") == 1
        is_first = F.col("first") == F.struct("id", "dig", "s")
        state = F.when(alone | (ended & is_first), 1).when(ended, 2).otherwise(0)
        again = (tied.join(g, ["r", "r2"])
                     .withColumns({"state": state, "tied": state == 0, "hist": F.when(state == 0, F.concat("hist", F.array("nr"))).otherwise(F.col("hist"))})
                     .select(*KEY, "seg", "s", F.col("nr").alias("r"), "rem", "m", "tied", "hist", "state"))
        live = again.unionByName(x.filter("alive AND NOT tied").drop("r2", "alive"))
        k += 1


def neighbours(ranks: DataFrame, stash: Stash) -> DataFrame:
    """(r, id, dig, s, m, lp): the suffix array with the longest common prefix with the suffix before,
    0 where it has fewer than m lines."""
    at = F.struct("id", "dig", "s", "hist", "rem")
    e = ranks.filter("state = 1 AND m IS NOT NULL").select("r", *KEY, "s", "rem", "m", "hist", F.shiftright("r", RADIX).alias("b"), at.alias("me"))
    last = e.groupBy("b").agg(F.max_by("me", "r").alias("last")).withColumn("left", F.lag("last").over(W.orderBy("b")))   # one row per 2^17 ranks
    e = e.join(last.select("b", "left"), "b").withColumn("prev", F.coalesce(F.lag("me").over(W.partitionBy("b").orderBy("r")), F.col("left")))

    def agree(a, b):
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))

    e = e.withColumn("level", F.when(F.col("prev").isNull(), 0).otherwise(agree(F.col("hist"), F.col("prev.hist"))))
    e = e.withColumn("most", F.coalesce(F.least("rem", "prev.rem"), F.lit(0)))
    e = e.withColumn("off", F.when(F.col("level") == 0, 0).otherwise(F.least(F.expr("shiftleft(1, level - 1)"), "most")))
    e = stash.put(e.select("r", *KEY, "s", "m", "most", "level", F.col("off").cast("long").alias("off"),
                           F.col("prev.id").alias("pid"), F.col("prev.dig").alias("pdig"), F.col("prev.s").alias("ps")), "lcp0")
    rows = ranks.select("id", "dig", "s", "hist")
    out, k = [], 0
    while True:
        # the rest is shorter than 2^(level-1) lines
        more = F.expr("level > 1 AND off < most AND off + shiftleft(1L, level - 1) - 1 >= m")
        out.append(e.filter(~more))
        todo = e.filter(more)
        if not has_rows(todo):
            break
        a = rows.select("id", "dig", F.col("s").alias("x"), F.col("hist").alias("ha"))
        b = rows.select(F.col("id").alias("pid"), F.col("dig").alias("pdig"), F.col("s").alias("y"), F.col("hist").alias("hb"))
        j = (todo.withColumns({"x": F.col("s") + F.col("off"), "y": F.col("ps") + F.col("off")})
                 .join(a, ["id", "dig", "x"]).join(b, ["pid", "pdig", "y"]))
        j = j.withColumn("level", F.least(agree(F.col("ha"), F.col("hb")), F.col("level") - 1))
        j = j.withColumn("off", F.when(F.col("level") == 0, F.col("off")).otherwise(F.least(F.col("off") + F.expr("shiftleft(1L, level - 1)"), "most")))
        k += 1
        e = stash.put(j.select(*todo.columns), f"lcp{k}")
    every = reduce(DataFrame.unionByName, out)
    return every.select("r", *KEY, "s", "m", F.when(F.col("off") >= F.col("m"), F.col("off")).otherwise(0).alias("lp"))


def earlier_copies(array: DataFrame, stash: Stash) -> DataFrame:
    """(id, dig, s, l): suffixes of the array with an earlier occurrence of their first l lines, l the longest."""
    a = stash.put(array.select("r", F.struct(*KEY, "s").alias("pos"), F.col("lp").cast("long").alias("lp")), "list")
    top = a.agg(F.max("r")).first()[0] or 0
    out, shift, k = [], RADIX, 0
    while has_rows(a):
        whole = top >> shift == 0
        b = F.shiftright("r", shift) if not whole else F.lit(0)
        w = W.partitionBy("b").orderBy("r")
        x = a.withColumn("b", b).withColumns({"prev": F.lag("pos").over(w), "next": F.lead("pos").over(w), "ln": F.lead("lp").over(w)})
        if whole:
            x = x.withColumn("ln", F.coalesce("ln", F.lit(0)))
        left = (F.col("lp") > 0) & (F.col("prev") < F.col("pos")) & (F.col("lp") >= F.col("ln"))
        right = (F.col("ln") > 0) & (F.col("next") < F.col("pos")) & (F.col("ln") >= F.col("lp"))
        x = x.withColumn("l", F.when(F.coalesce(left, F.lit(False)), F.col("lp")).when(F.coalesce(right, F.lit(False)), F.col("ln")))
        x = x.withColumn("gone", F.col("l").isNotNull() | F.coalesce((F.col("lp") == 0) & (F.col("ln") == 0), F.lit(False)))
        stays = F.sum((~F.col("gone")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
        x = x.withColumn("grp", F.coalesce(stays, F.lit(0)))
        x = x.withColumn("least", F.min("lp").over(W.partitionBy("b", "grp").orderBy("r").rowsBetween(W.unboundedPreceding, 0)))
        x = stash.put(x.select("r", "pos", "l", "gone", F.col("least").alias("lp")), f"settled{k}")
        out.append(x.filter("l IS NOT NULL").select("pos.*", "l"))
        a = x.filter("NOT gone").select("r", "pos", "lp")
        shift, k = shift + 2, k + 1
    return reduce(DataFrame.unionByName, out) if out else array.select(*KEY, "s", F.col("lp").alias("l")).limit(0)


def deletions(lines: DataFrame, stash: Stash, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, dig, cuts): disjoint (from, to) spans of worded lines to delete, per document that has any."""
    ranks = suffix_ranks(segments(lines, stash, min_words), stash)
    copies = earlier_copies(neighbours(ranks, stash), stash)
    spans = copies.select(*KEY, F.col("s").cast("int").alias("s"), (F.col("s") + F.col("l") - 1).cast("int").alias("e")).unionByName(
        ranks.filter("state = 2 AND m IS NOT NULL").select(*KEY, F.col("s").cast("int").alias("s"), (F.col("s") + F.col("rem") - 1).cast("int").alias("e")))
    w = W.partitionBy(*KEY).orderBy("s", "e")
    new = F.coalesce(F.col("s") > F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy(*KEY, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return stash.put(merged.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cuts")), "cuts")


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deduplicated text, n_lines (lines with a word) and n_removed; one row per input row."""
    keys = _key_columns(docs, id_col, text_col)
    keyed = docs.select(keys[0].alias("id"), keys[1].alias("dig"), docs[text_col].alias("text"))
    stash = Stash(docs.sparkSession, "linedup")
    lines = line_rows(keyed, stash)
    # wholly equal rows: the later ones are copies of the first, whatever the runs in them
    repeated = stash.put(lines.filter("s = 0").groupBy(*KEY).agg(F.count("*").alias("c")).filter("c > 1"), "repeated")
    cuts = deletions(lines, stash, min_words).join(repeated, KEY, "full")
    cuts = stash.put(cuts.select(F.col("id").alias("_id"), F.col("dig").alias("_dig"), "cuts"), "plan")
    j = docs.select("*", *[c.alias(f"_k_{n}") for n, c in zip(KEY, keys)])
    j = may_be_in(j, "_k_dig", cuts, "_dig", "_hit")
    # only texts that may lose lines are shuffled to the join, at every size
    hit = j.filter("_hit").join(cuts.hint("merge"), (F.col("_k_id") == F.col("_id")) & (F.col("_k_dig") == F.col("_dig")), "left")
    hit = hit.withColumn("_nth", F.row_number().over(W.partitionBy("_k_id", "_k_dig").orderBy(F.lit(0))))
    rest = j.filter("NOT _hit").select("*", *[F.lit(None).cast(cuts.schema[c].dataType).alias(c) for c in cuts.columns]).withColumn("_nth", F.lit(1))
    j = rest.unionByName(hit)
    text = F.col(f"`{text_col}`")
    j = j.withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    at = F.filter(F.transform("_lines", lambda x, i: F.when(F.length(F.btrim(x, F.lit(SPACES))) > 0, i)), lambda i: i.isNotNull())
    j = j.withColumn("_at", at)
    gone = F.flatten(F.transform("cuts", lambda c: F.slice(F.col("_at"), c["s"] + 1, c["e"] - c["s"] + 1)))
    j = j.withColumn("_gone", F.coalesce(gone, F.array().cast("array<int>")))
    copy = (F.col("_nth") > 1) & (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) >= min_words)
    j = j.withColumn("_gone", F.when(copy, F.col("_at")).otherwise(F.col("_gone")))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    new = F.when(F.size("_gone") == 0, text).otherwise(F.array_join(F.transform(keep, lambda i: F.get("_lines", i)), "\n"))
    return j.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                    F.size("_at").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))
