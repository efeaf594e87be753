"""N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct 5-word shingles (64-bit hashes).  Documents link
when 100 * |A n B| >= threshold * |A u B|; the result is exact, no partner is capped.

1. Equal sets fall into one class (hash of the set); only classes go on.
2. In an order of tokens that puts those found in many documents last, linked sets
   share a token among the larger one's first |A| - ceil(t |A|) + 1 and the smaller one's
   first |A| - ceil(2 t |A| / (1 + t)) + 1 (prefix filter).  The
   order needs no exact counts, any order is valid: each task counts the tokens that
   it meets twice or more in a chunk, and these counts are added up over all documents.
3. Groups: prefix tokens are brought together by a sort; in each token's run the class
   with the fewest rare tokens is the leader, and every other one is compared with it.
   Verified links make groups of similar classes (connected through their leaders).
4. Token-group matrix: components so far are cut into groups of bounded size.  A class of the
   smaller component is a query against the groups of the larger with which it shares a
   prefix token.  The matrix stores the whole token union of each such group, as bits at hashed
   tokens: a bit of the query that the union lacks is a token or more that no member has.  A group
   whose union can hold fewer than t |Q| of its tokens cannot hold a partner; only
   qualifying groups are opened and their members compared.
5. Connected components of all links; a component's id is its smallest doc_id.

Every class has such bits (at least four per token, so at most a byte per token); a pair of a
leader and another class is bounded by them as well.  Texts travel only for pairs and groups
that the bits leave open, and decide by the shingles themselves.
Runs and comparisons stream over sorted partitions and hold one leader's set at a
time.  Runs of very common tokens and the members of one leader are split by salt.

Defined cases: null text, or text without words, has an empty set, linked with nothing;
texts with fewer words than ``width`` have one shingle, the whole sequence; repeated
rows and ids are rows of one class; a null id never becomes a component id unless the
whole component has none; an empty table gives an empty result.  Two different sets
are taken for equal, or two shingles, only if their 64-bit hashes agree.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Stash, has_rows, may_be_in, pick, small_batches

WIDTH, THRESHOLD = 5, 80
CHUNK_TOKENS = 4_000_000     # tokens that a task counts at a time
MAX_COMMON = 500_000         # entries of the broadcast table of common tokens (12 bytes each)
SALT_BITS = 14               # runs, leaders and groups are split into parts of about 2^14 rows
GROUP_TOKENS = 500_000       # token hashes of a group, 4 MB
CACHE_WORDS = 400_000
SLICE_ROWS = 1024            # rows of an Arrow batch that a task turns into Python values at a time


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # lower-cases A-Z, splits at the six white-space characters
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        h = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh64_intdigest(w)
            h.append(x)
        h = np.array(h, np.uint64)
        k = min(self.width, len(h))
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            acc = (acc ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        return np.unique(acc)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


class Tokens:
    """Token hashes of many sets, copied into one array, so that the sets themselves can go."""

    def __init__(self, room: int):
        self.all, self.n = np.empty(room, np.uint64), 0

    def add(self, t: np.ndarray) -> None:
        end = self.n + len(t)
        if end > len(self.all):
            more = np.empty(max(end, len(self.all) + len(self.all) // 4), np.uint64)
            more[:self.n] = self.all[:self.n]
            self.all = more
        self.all[self.n:end] = t
        self.n = end

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of two sets or more and their counts; the array starts anew."""
        tokens, self.n = self.all[:self.n], 0
        tokens.sort()               # in place: np.unique of all would hold several copies
        twice = np.flatnonzero(tokens[1:] == tokens[:-1])
        tokens, counts = np.unique(tokens[twice], return_counts=True)
        return tokens, counts + 1


def _class_of(t: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(t.tobytes())).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a task holds few texts and tokens as Python values."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def _level(n: int) -> int:
    """log2 of the number of bits for n tokens; sizes of linked sets differ by one level at most."""
    return max(6, (4 * n - 1).bit_length())


def _bits(t: np.ndarray) -> bytes:
    """A set's bits: one at each token's hash modulo their number."""
    size = 1 << _level(len(t))
    bits = np.zeros(size, np.uint8)
    bits[(t & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bits that fewer bytes would have had."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def _lacking(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many tokens of the set with bits ``a`` are not in that with bits ``b``."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_fold(a, size) & ~_fold(b, size)).sum())


def _prefix(n: int, threshold: int) -> int:
    """Tokens of a set that meet those of a smaller or equal one: an overlap is at least t n."""
    return n - (threshold * n + 99) // 100 + 1


def _short(n: int, threshold: int) -> int:
    """Of these, those that meet a larger or equal one: the overlap is then at least 2 t n / (1 + t)."""
    return n + (-2 * threshold * n) // (100 + threshold) + 1


def census(docs: DataFrame, width: int) -> DataFrame:
    """Rows (kind, doc_id, mark, cls, n, bits): kind 0 a document's class and set size, with its bits where
    a task first meets the class, kind 1 a token and its count in a chunk."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "doc_id", "mark", "cls", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, seen, id_t = Shingler(width), Tokens(CHUNK_TOKENS), set(), None

        def counted():
            tokens, counts = held.repeated()
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), pa.nulls(len(tokens), id_t), pa.nulls(len(tokens), pa.int64()),
                                               _signed(tokens), pa.array(counts.astype(np.int64)), pa.nulls(len(tokens), pa.binary())], names)

        for b in _slices(batches):
            id_t, cls, n, bits = b.column("doc_id").type, [], [], []
            for text in b.column("text").to_pylist():
                t = shingles(text)
                n.append(len(t))
                cls.append(_class_of(t) if len(t) else None)
                bits.append(None)
                if len(t) and cls[-1] not in seen:
                    seen.add(cls[-1])
                    held.add(t)
                    bits[-1] = _bits(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column("doc_id"), b.column("mark"), pa.array(cls, pa.int64()),
                                              pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names)
            if held.n > CHUNK_TOKENS:
                yield counted()
                seen = set()
        if held.n:
            yield counted()

    return docs.select("doc_id", "mark", "text").mapInArrow(run, f"kind int, doc_id {id_type}, mark long, cls long, n long, bits binary")


def common_tokens(counts: DataFrame, limit: int = MAX_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``limit`` most frequent tokens, sorted, and log2 of their counts.  They only order tokens."""
    sums = counts.groupBy("token").agg(F.sum("n").alias("n")).withColumn("level", F.length(F.bin("n")))
    levels = sorted(((r["level"], r["c"]) for r in sums.groupBy("level").agg(F.count("*").alias("c")).collect()), reverse=True)   # <= 64 rows
    least, total = 64, 0
    for level, c in levels:
        if level < 4 or total + c > limit:     # fewer than 8 documents do no harm in front
            break
        least, total = level, total + c
    rows = sums.filter(F.col("level") >= least).select("token", "level").toPandas() if total else None
    if rows is None:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["level"].to_numpy(np.int8)[order]


def postings(docs: DataFrame, common, width: int, threshold: int) -> DataFrame:
    """(token, salt, rare, cls, n, short): each class's prefix tokens; rare = how many of its tokens are
    not common, short = the token is among the first that a larger partner must share."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(width), set()
        tokens, levels = shared.value
        for b in _slices(batches):
            out = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                t = shingles(text)
                cls = _class_of(t) if len(t) else None
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, t), len(tokens) - 1)
                    level = np.where(tokens[at] == t, levels[at], 0)
                else:
                    level = np.zeros(len(t), np.int8)
                rare = int((level == 0).sum())
                first = np.argsort(level, kind="stable")[:_prefix(len(t), threshold)]
                out[0].append(t[first])
                over = np.maximum(level[first].astype(np.int64) - SALT_BITS, 0)
                out[1].append(np.where(over > 0, cls % (1 << over), -1))
                for col, v in zip(out[2:5], (rare, cls, len(t))):
                    col.append(np.full(len(first), v, np.int64))
                out[5].append(np.arange(len(first)) < _short(len(t), threshold))
            if out[0]:
                c = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([_signed(c[0]), *map(pa.array, c[1:])], ["token", "salt", "rare", "cls", "n", "short"])

    return docs.select("text").mapInArrow(run, "token long, salt long, rare long, cls long, n long, short boolean")


def shared_postings(rows: DataFrame) -> DataFrame:
    """(token, salt, cls, n, short, leader, leader_n, leader_short) of tokens that several classes share, by one sort and a streaming pass.

    A leader has a row of its own only in a salted run, where the parts' leaders have not been compared.
    """
    names = ["token", "salt", "cls", "n", "short", "leader", "leader_n", "leader_short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key, lead, last = None, None, None
        for b in batches:
            token, salt, cls, n, short = (b.column(x).to_numpy(zero_copy_only=False) for x in ("token", "salt", "cls", "n", "short"))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            new[0] = run_key != (token[0], salt[0])
            again = np.zeros(len(token), bool)
            again[1:] = ~new[1:] & (cls[1:] == cls[:-1])
            again[0] = not new[0] and cls[0] == last
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            lead_cls = np.where(start >= 0, cls[start], lead[0] if lead else 0)
            lead_n = np.where(start >= 0, n[start], lead[1] if lead else 0)
            lead_short = np.where(start >= 0, short[start], lead[2] if lead else False)
            other = ~new & ~again
            own = new & (salt >= 0)
            pick_ = np.concatenate([np.flatnonzero(other), np.flatnonzero(own)])
            if len(pick_):
                yield pa.RecordBatch.from_arrays([pa.array(x[pick_]) for x in (token, salt, cls, n, short, lead_cls, lead_n, lead_short)], names)
            run_key, lead, last = (token[-1], salt[-1]), (int(lead_cls[-1]), int(lead_n[-1]), bool(lead_short[-1])), cls[-1]

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "rare", "cls")
    return dealt.mapInArrow(run, "token long, salt long, cls long, n long, short boolean, leader long, leader_n long, leader_short boolean")


def may_link(threshold: int):
    """A class and its run's leader, by their sizes and by where the token stands in their orders."""
    return ((100 * F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n"))
            & ((F.col("n") > F.col("leader_n")) | F.col("short")) & ((F.col("n") < F.col("leader_n")) | F.col("leader_short")))


def led(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(leader, part, role, cls, ...): the rows (cls, ...) of leaders, role 0, before those of their members, role 1.

    A leader's row is repeated for each part of its members; a part streams past it.
    """
    carried = [c for c in rows.columns if c != "cls"]
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / (1 << SALT_BITS)).cast("int").alias("parts"))
    members = (pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
                    .join(rows.hint("merge"), "cls").select("leader", "part", F.lit(1).alias("role"), "cls", *carried))
    leaders = (parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
                    .join(rows.withColumnRenamed("cls", "leader").hint("merge"), "leader")
                    .select("leader", "part", F.lit(0).alias("role"), F.col("leader").alias("cls"), *carried))
    return leaders.unionByName(members).repartition("leader", "part").sortWithinPartitions("leader", "part", "role", "cls")


def near(pairs: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """The (leader, cls) pairs that may link by their bits.  bits: (cls, n, bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_n, held = None, 0, None
        for b in _slices(batches):
            a_, b_ = [], []
            for leader, role, cls, n, x in zip(*(b.column(x).to_pylist() for x in ("leader", "role", "cls", "n", "bits"))):
                own = np.frombuffer(x, np.uint8)
                if role == 0:
                    lead, lead_n, held = leader, n, own
                elif lead == leader:
                    both = min(n - _lacking(own, held), lead_n - _lacking(held, own))
                    if 100 * both >= threshold * (n + lead_n - both):
                        a_.append(leader)
                        b_.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["leader", "cls"])

    return led(pairs, bits).mapInArrow(run, "leader long, cls long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(a, b) of the (leader, cls) pairs that link.  texts: (cls, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, lead, held = Shingler(width), None, None
        for b in _slices(batches):
            a_, b_ = [], []
            for leader, role, cls, text in zip(*(b.column(x).to_pylist() for x in ("leader", "role", "cls", "text"))):
                if role == 0:
                    lead, held = leader, shingles(text)
                else:
                    t = shingles(text)
                    both = len(np.intersect1d(held, t, assume_unique=True))
                    if lead == leader and 100 * both >= threshold * (len(held) + len(t) - both):
                        a_.append(leader)
                        b_.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return led(pairs, texts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, stash: Stash, name: str) -> DataFrame:
    """(node, comp) of the nodes that have an edge, by alternating large-star and small-star rounds."""
    e = stash.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-edges")
    mark = None
    for i in range(200):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stash.put(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                      .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{i}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    own = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own)


def with_groups(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(cls, n, comp, part): classes by component, a component being split into groups of about
    ``GROUP_TOKENS`` tokens, so that a group's sets fit a task's memory."""
    c = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", F.coalesce("comp", "cls").alias("comp"))
    parts = c.groupBy("comp").agg(F.sum("n").alias("tokens"), F.count("*").alias("members")).withColumn("parts", F.ceil(F.col("tokens") / GROUP_TOKENS))
    return c.join(parts, "comp").select("cls", "n", "comp", "members", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))


def group_queries(shared: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """(cls, comp, part): queries and the groups whose matrix row holds one of their prefix tokens.

    A run's leader has been compared with all of the run, so only the others can still
    have partners that nobody has seen.  Of two components the members of the smaller one
    are the queries, and a group's sizes must fit.
    """
    cells = shared.select("token", "cls", "short").join(groups, "cls")
    # sizes of partners lie in one bucket or in two that touch: a token counts where another component is that near in size
    step = max(math.log(100 / threshold), 1e-3) * (1 + 1e-9)
    cells = cells.withColumn("size", F.floor(F.log("n") / step).cast("int"))
    open_ = (cells.withColumn("pair", F.explode(F.array("size", F.col("size") + 1))).groupBy("token", "pair")
                  .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("short")).filter("lo <> hi AND short")
                  .groupBy("token").agg(F.collect_set("pair").alias("pairs")))      # a few dozen sizes at most
    cells = (cells.join(open_, "token").filter(F.array_contains("pairs", F.col("size")) | F.array_contains("pairs", F.col("size") + 1))
                  .drop("pairs", "size"))
    # at most a prefix of tokens per class: two classes meet at one token only, the smallest that counts for them
    lists = cells.groupBy("cls").agg(F.collect_list("token").alias("all"), F.collect_list(F.when(F.col("short"), F.col("token"))).alias("first"))
    cells = cells.join(lists, "cls")
    alone = F.first("members") == 1
    matrix = (cells.groupBy("token", F.col("comp").alias("g_comp"), F.col("part").alias("g_part"))
                   .agg(F.first("members").alias("g_members"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"),
                        F.min(F.when(F.col("short"), F.col("n"))).alias("s_lo"), F.max(F.when(F.col("short"), F.col("n"))).alias("s_hi"),
                        F.when(alone, F.first("all")).alias("g_all"), F.when(alone, F.first("first")).alias("g_first")))
    ask = cells.select("token", "cls", "n", "short", "comp", "members", "all", "first").join(matrix, "token")
    n = F.col("n")
    larger = F.col("short") & (F.col("n_hi") >= n) & (100 * n >= threshold * F.col("n_lo"))
    lower = (F.col("s_lo") <= n) & (100 * F.col("s_hi") >= threshold * n)
    smaller = (F.col("members") < F.col("g_members")) | ((F.col("members") == F.col("g_members")) & (F.col("comp") < F.col("g_comp")))
    common = (F.when(n < F.col("n_lo"), F.array_intersect("first", "g_all")).when(n > F.col("n_lo"), F.array_intersect("all", "g_first"))
               .otherwise(F.array_intersect("first", "g_first")))
    fits = 100 * F.least(n, F.col("n_lo")) >= threshold * F.greatest(n, F.col("n_lo"))
    one = fits & F.coalesce(F.col("token") == F.array_min(common), F.lit(False))
    meets = F.when(F.col("g_all").isNotNull(), one).otherwise(larger | F.coalesce(lower, F.lit(False)))
    return (ask.filter((F.col("comp") != F.col("g_comp")) & smaller & meets)
               .select("cls", F.col("g_comp").alias("comp"), F.col("g_part").alias("part")).distinct())


def unions(groups: DataFrame, bits: DataFrame) -> DataFrame:
    """The matrix: (comp, part, level, bits), the token union of each group's members of a level, in one streaming pass."""
    names = ["comp", "part", "level", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()),
                                               pa.array([held.tobytes()], pa.binary())], names)

        for b in _slices(batches):
            for comp, part, level, x in zip(*(b.column(x).to_pylist() for x in names)):
                own = np.frombuffer(x, np.uint8)
                if (comp, part, level) == key:
                    held = held | own
                else:
                    if key:
                        yield row()
                    key, held = (comp, part, level), own
        if key:
            yield row()

    level = F.length(F.bin(F.octet_length("bits"))) + 2         # 8 * 2^(level - 3) bits
    rows = groups.join(bits.hint("merge"), "cls").select("comp", "part", level.alias("level"), "bits")
    return rows.repartition("comp", "part", "level").sortWithinPartitions("comp", "part", "level").mapInArrow(run, "comp long, part int, level int, bits binary")


def qualifying(ask: DataFrame, matrix: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """The (cls, comp, part) of ``ask`` whose group's union may hold enough of the query's tokens.

    A query meets the unions of its own level and the two beside it; those queries of a group that
    make more than a part's rows are split by salt, the unions being repeated.
    """
    spread = ask.groupBy("comp", "part").agg(F.ceil(F.count("*") / (1 << SALT_BITS)).cast("int").alias("salts"))
    rows = (matrix.join(spread, ["comp", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                  .select("comp", "part", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("cls"), F.lit(0).cast("long").alias("n"), "bits"))
    asked = (ask.join(spread, ["comp", "part"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
                .join(bits.hint("merge"), "cls").select("comp", "part", "salt", F.lit(1).alias("role"), "cls", "n", "bits"))
    dealt = rows.unionByName(asked).repartition("comp", "part", "salt").sortWithinPartitions("comp", "part", "salt", "role", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for b in _slices(batches):
            out = [], [], []
            for comp, part, salt, role, cls, n, x in zip(*(b.column(x).to_pylist() for x in ("comp", "part", "salt", "role", "cls", "n", "bits"))):
                if (comp, part, salt) != key:
                    key, held = (comp, part, salt), {}
                own = np.frombuffer(x, np.uint8)
                if role == 0:
                    held[len(own)] = own
                elif any(100 * (n - _lacking(own, held[size])) >= threshold * n for size in (len(own) // 2, len(own), len(own) * 2) if size in held):
                    for col, v in zip(out, (cls, comp, part)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["cls", "comp", "part"])

    return dealt.mapInArrow(run, "cls long, comp long, part int")


def opened(ask: DataFrame, groups: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(a, b): a query's first link into each group that it opens.

    A group's members come first and make its token union; the queries stream past.  A
    query is compared with the members only if the union holds enough of its tokens.
    """
    spread = ask.groupBy("comp", "part").agg(F.ceil(F.count("*") / (1 << SALT_BITS)).cast("int").alias("salts"))
    members = (groups.join(spread, ["comp", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
                     .select("comp", "part", "salt", F.lit(0).alias("role"), "cls"))
    asked = (ask.join(spread, ["comp", "part"]).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
                .select("comp", "part", "salt", F.lit(1).alias("role"), "cls"))
    rows = members.unionByName(asked).join(texts.hint("merge"), "cls").select("comp", "part", "salt", "role", "cls", "text")
    dealt = rows.repartition("comp", "part", "salt").sortWithinPartitions("comp", "part", "salt", "role", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, key, held, union = Shingler(width), None, [], None
        for b in _slices(batches):
            a_, b_ = [], []
            for comp, part, salt, role, cls, text in zip(*(b.column(x).to_pylist() for x in ("comp", "part", "salt", "role", "cls", "text"))):
                if (comp, part, salt) != key:
                    key, held, union = (comp, part, salt), [], None
                t = shingles(text)
                if role == 0:
                    held.append((cls, t))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([x for _, x in held])) if held else t[:0]
                if 100 * len(np.intersect1d(union, t, assume_unique=True)) < threshold * len(t):
                    continue
                for other, x in held:
                    if 100 * min(len(x), len(t)) >= threshold * max(len(x), len(t)):
                        both = len(np.intersect1d(x, t, assume_unique=True))
                        if 100 * both >= threshold * (len(x) + len(t) - both):
                            a_.append(cls)
                            b_.append(other)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def marked_texts(docs: DataFrame, where: DataFrame) -> DataFrame:
    """(cls, text) of the sampled documents (cls, i, m); a bitmap keeps the others out of the join's shuffle."""
    d = may_be_in(docs, "mark", where, "m", "wanted").filter("wanted")
    where = where.hint("merge")         # by shuffle at every size
    return d.join(where, d["doc_id"].eqNullSafe(where["i"]) & (d["mark"] == where["m"])).select("cls", "text")


def join(docs: DataFrame, id_col="doc_id", text_col="text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, mark, n_shingles, class_id, component, component_id), one row per document.

    mark = xxhash64 of its text; component = a class of its component, component_id = the smallest doc_id there."""
    stash = Stash(docs.sparkSession, "jaccard")
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.xxhash64("text"))
    seen = stash.put(census(d, width), "census")
    rows = seen.filter("kind = 0").select("doc_id", "mark", "cls", "n", "bits")
    classes = stash.put(rows.filter("cls IS NOT NULL").groupBy("cls", "n").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("sample"), F.first("bits", True).alias("bits")), "classes")
    bits = classes.select("cls", "n", "bits")
    common = common_tokens(seen.filter("kind = 1").select(F.col("cls").alias("token"), "n"))
    shared = stash.put(shared_postings(postings(d, common, width, threshold)), "shared")

    led_by = shared.filter((F.col("cls") != F.col("leader")) & may_link(threshold)).select("leader", "cls").distinct()
    pairs = stash.put(near(stash.put(led_by, "led"), bits, threshold), "pairs")

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:      # wholly equal rows give a class more than once
        where = wanted.distinct().join(classes, "cls").select("cls", F.col("sample.doc_id").alias("i"), F.col("sample.mark").alias("m"))
        return stash.put(marked_texts(d, where), name)

    texts = texts_of(pairs.select("cls").unionByName(pairs.select(F.col("leader").alias("cls"))), "texts")
    links = stash.put(verified(pairs, texts, width, threshold), "links")
    stash.drop("led", "pairs", "texts")
    comps = stash.put(components(links, stash, "comps"), "comps")

    groups = stash.put(with_groups(classes, comps), "groups")
    ask = stash.put(group_queries(shared, groups, threshold), "queries")
    stash.drop("shared")
    if has_rows(ask):
        matrix = stash.put(unions(groups.join(ask.select("comp", "part").distinct(), ["comp", "part"], "left_semi"), bits), "matrix")
        ask = stash.put(qualifying(ask, matrix, bits, threshold), "qualifying")
    if has_rows(ask):
        asked = stash.put(groups.join(ask.select("comp", "part").distinct(), ["comp", "part"], "left_semi"), "asked")
        more = texts_of(asked.select("cls").unionByName(ask.select("cls")), "more")
        found = stash.put(opened(ask, asked, more, width, threshold), "found")
        if has_rows(found):
            comps = stash.put(components(links.unionByName(found), stash, "all"), "components")
    of = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("comp", "cls").alias("comp"))
    of = stash.put(of.join(of.groupBy("comp").agg(F.min("first").alias("least")), "comp").select("cls", "comp", "least"), "of")
    return (rows.join(of, "cls", "left")
                .select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.col("comp").alias("component"),
                        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """One document of each group: that with the smallest id (of rows of one id, one; of a group without ids, one).  Documents without words stay."""
    j = join(docs, id_col, text_col, **kw)
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("component "), F.col("component").cast("string")))
    first = j.filter("class_id IS NOT NULL").groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("_id"), F.col("x.mark").alias("_mark")).unionByName(
        j.filter("class_id IS NULL").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    marked = docs.withColumn("_m", F.xxhash64(docs[text_col]))
    kept = marked.join(keep, marked[id_col].eqNullSafe(keep["_id"]) & marked["_m"].eqNullSafe(keep["_mark"]))
    twin = W.partitionBy(kept[id_col], "_m").orderBy(F.lit(0))
    words = F.length(F.btrim(F.coalesce(docs[text_col], F.lit("")), F.lit(" \t\n\x0b\f\r"))) > 0
    return kept.withColumn("_nth", F.row_number().over(twin)).filter((F.col("_nth") == 1) | ~words).select(*[docs[c] for c in docs.columns])
