"""Best-fit packing of token sequences (best-two-fit).

Documents are tokenised once, in Arrow batches; what travels afterwards is one
narrow row per piece.  Piece lengths are integers of at most ``capacity``, so the
packing is decided on the histogram of lengths (``capacity`` counters at most,
whatever the data's size): a bin takes the longest remaining length, is filled
greedily with the longest that fits, and as long as a gap is left its smallest
document is replaced with two unpacked documents that fit the widened gap more
tightly.  A bin pattern is repeated as often as the counts allow.  Pieces then get
their place by their rank among pieces of their length; the rank comes from counts
per (length, hash bucket) and a window inside one bucket, so no length is ranked
in one task.

Defined cases: null and empty texts are one end token; repeated rows are packed
each on its own (which of two equal rows gets which place is arbitrary); an empty
table gives an empty result; texts are never shortened.
"""
from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Stash, pick, small_batches

CAPACITY, END_ID = 1024, 2
BUCKET_ROWS = 50_000     # mean rows of a (length, bucket) group
CACHE_WORDS = 400_000    # entries of a task's word cache; it starts anew beyond that

# Letters, digits and white space below U+0250 in the vocabulary's own split pattern.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-\x1b\x20-\u024f]")


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian uint32 bytes.

    Texts of Latin letters are split by the vocabulary's pattern and each distinct
    piece is encoded once (``tiktoken`` over the same ranks); any other text goes to
    ``tokenizers`` whole.  The ids are those of ``tokenizers`` either way.  Strings of
    special tokens in a text are ordinary text, unless ``specials`` is set: then they get
    their own ids, as in a plain call of the file's tokenizer.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str, specials: bool = False):
        import tiktoken
        from tokenizers import Tokenizer
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.whole.encode_special_tokens = not specials
        named = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()] if specials else []
        self.to_whole = re.compile("|".join([_OTHER.pattern, *named]))
        self.words: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if self.to_whole.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        found = _LATIN.findall(text)
        out = list(map(words.get, found))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    w = found[i]
                    out[i] = words.get(w)
                    if out[i] is None:
                        new = self.bpe.encode_ordinary(w)
                        out[i] = words[w] = struct.pack(f"<{len(new)}I", *new)
        return b"".join(out)


def public_encoder(specials: bool = False) -> Encoder:
    import public_tokenizers as P
    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, specials)


def file_encoder() -> Encoder:
    """Ids as the vocabulary file's own tokenizer gives them, special tokens inside texts included."""
    return public_encoder(specials=True)


def pieces(docs: DataFrame, id_col="doc_id", text_col="text", capacity: int = CAPACITY, end_id: int = END_ID,
           encoder=file_encoder) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than ``capacity`` are cut, the first piece takes the remainder."""
    d = pick(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                data = encode(text or "") + end
                n = len(data) // 4
                edges = list(range((n - 1) % capacity + 1, n + 1, capacity))
                for i, (lo, hi) in enumerate(zip([0, *edges], edges)):
                    row.append(r)
                    piece.append(i)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(data[4 * lo:4 * hi]))
            ids = b.column("doc_id").take(pa.array(row, pa.int64()))
            cols = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return d.mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Best-two-fit over a histogram of lengths: (how many bins, their lengths) patterns."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    plans = []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        free, here, gap = left.copy(), Counter(), capacity
        while gap:
            fits = np.flatnonzero(free[1:min(gap, top) + 1])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            take = int(min(free[n], gap // n))
            here[n] += take
            free[n] -= take
            gap -= n * take
        while gap and sum(here.values()) > 1:
            small = min(here)
            room = gap + small
            have = np.flatnonzero(free[:room])
            if len(have) == 0:
                break
            at_most = np.zeros(room + 1, dtype=np.int64)
            at_most[have] = have
            at_most = np.maximum.accumulate(at_most)
            mate = np.minimum(at_most[room - have], at_most[have])
            alone = (mate == have) & (free[have] < 2)      # a length cannot pair with itself when only one is left
            mate = np.where(alone, at_most[have - 1], mate)
            both = np.where(mate > 0, have + mate, 0)
            best = int(np.argmax(both))
            if both[best] <= small:
                break
            a, b = int(have[best]), int(mate[best])
            here[small] -= 1
            free[small] += 1
            if not here[small]:
                del here[small]
            for n in (a, b):
                here[n] += 1
                free[n] -= 1
            gap = room - a - b
        times = min(int(left[n] // c) for n, c in here.items())
        for n, c in here.items():
            left[n] -= times * c
        plans.append((times, [n for n in sorted(here, reverse=True) for _ in range(here[n])]))
    return plans


def _places(plans) -> dict[int, tuple]:
    """length -> (first rank, first sequence, offset) arrays, one entry per slot of a pattern."""
    out: dict[int, list] = {}
    used, sequence = Counter(), 0
    for times, lengths in plans:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for n, rows in out.items()}


def pack(docs: DataFrame, id_col="doc_id", text_col="text", capacity: int = CAPACITY, end_id: int = END_ID,
         encoder=file_encoder) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    stash = Stash(spark, "pack")
    small_batches(spark)
    rows = stash.put(pieces(docs, id_col, text_col, capacity, end_id, encoder), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(_places(plan_bins(counts, capacity)))   # slots of patterns, not of data
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
                .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (rows.withColumn("nth", F.row_number().over(inside)).join(base, ["length", "bucket"])
                  .withColumn("rank", F.col("base") + F.col("nth") - 1)
                  .select("doc_id", "piece", "start", "length", "ids_crc32", "rank"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                first, seq, off = places.value[int(length)]
                at = np.flatnonzero(n == length)
                slot = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[slot] + rank[at] - first[slot], off[slot]
            keep = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
