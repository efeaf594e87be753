"""Cross-tokenizer alignment (inverted pair bitmaps).

Tokeniser A (byte-level BPE) and tokeniser B (sentence pieces) cut the same bytes; A reads
a space and the text, B the text, in front of which it puts its own space.  Offsets where a
token of A and one of B both end cut the two sequences into groups; the two tokens that end
there are linked.

Documents are aligned in the tasks and inverted at once: documents are numbered within a
chunk (at most ``CHUNK_DOCS`` documents, closed early after ``CHUNK_LINKS`` links, however
few or many a task has), and each pair of ids gets, per chunk, bitmaps of the documents that
link it.  Plane k holds the documents whose number of links has bit k set; so the planes
OR-merged and popcounted give the pair's documents, and their popcounts times 2^k its links.
A bitmap is stored as sorted 16-bit document numbers or as plain bits, whichever is shorter.
Summed over chunks (which share no document), these are the corpus-wide counts; a B id's
best pair is the largest.  A pair meets a chunk once, so however common it is, it never has
more rows than there are chunks, and no key is hot.  The scores go back the way they came: a
chunk takes the counts of its pairs, and the postings return them to their documents.

Defined cases: null and empty texts, and texts whose joined token bytes are not a space and
the text (a U+2581 comes back as a space), have no tokens: zeros and an empty ``groups``;
special tokens' strings inside a text are ordinary text; long texts are aligned whole;
repeated rows are documents of their own; extra columns are left out; an empty table gives
an empty result.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, pick
from .pack import Encoder, public_encoder

CHUNK_DOCS = 1 << 16
CHUNK_LINKS = 1 << 20
SLICE = 256              # documents encoded at a time
CACHE_WORDS = 150_000    # entries of a task's word cache of A


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Strings:
    """Byte strings by number, to be joined by an array of numbers in one gather."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """ends: the running sum of the sizes of ``ids``, where it is known."""
        size = self.size[ids]
        ends = np.cumsum(size) if ends is None else ends
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])] if len(ids) else self.flat[:0]


class Aligner:
    """Aligned tokens of texts: (number of A ids, of B ids, of groups, group text, linked A id * 2^32 + B id)."""

    NONE = (0, 0, 0, "", np.zeros(0, np.int64))

    def __init__(self, a: Encoder, b_path: str):
        import sentencepiece
        self.a, self.b = a, sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_alphabet()
        names = a.whole.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(names.values()) + 1)
        for x, i in names.items():
            if all(c in table for c in x):
                a_bytes[i] = bytes(table[c] for c in x)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(pieces)]
        self.a_bytes, self.b_bytes = Strings(a_bytes), Strings(b_bytes)
        # An id as it stands in the group text: A inside a group, A at its end, B inside, B at its end.
        n, m = len(a_bytes), len(pieces)
        self.shown = Strings([b"%d%c" % (i, mark) for size, marks in ((n, b",|"), (m, b",;")) for mark in marks for i in range(size)])

    def one(self, text: str, b_ids: list[int]) -> tuple:
        text = " " + text
        raw, a, b = np.frombuffer(text.encode(), np.uint8), np.frombuffer(self.a(text), "<u4").astype(np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        if not (np.array_equal(self.a_bytes.joined(a, a_end), raw) and np.array_equal(self.b_bytes.joined(b, b_end), raw)):
            return self.NONE
        meets = np.searchsorted(b_end, a_end)                 # both end at the text's end, so every place exists
        a_last = b_end[meets] == a_end
        b_last = np.zeros(len(b), bool)
        b_last[meets[a_last]] = True
        order = np.argsort(np.concatenate([2 * (np.cumsum(a_last) - a_last), 2 * (np.cumsum(b_last) - b_last) + 1]), kind="stable")
        n, m = len(self.a_bytes.size), len(self.b_bytes.size)
        code = np.concatenate([a + n * a_last, b + 2 * n + m * b_last])[order]
        groups = self.shown.joined(code)[:-1].tobytes().decode()
        return len(a), len(b), int(a_last.sum()), groups, (a[a_last] << 32) | b[b_last]

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        if len(self.a.words) > CACHE_WORDS:
            self.a.words.clear()
        ids = self.b.encode([t or "" for t in texts], num_threads=1)
        return [self.one(t, i) if t else self.NONE for t, i in zip(texts, ids)]


@functools.lru_cache(maxsize=2)
def load(encoder: Callable, b_path: str) -> Aligner:
    return Aligner(encoder(), b_path)


def public_aligner() -> Aligner:
    import public_tokenizers as P
    return load(public_encoder, P.path("piece_bpe_32k.model"))


def align(docs: DataFrame, id_col="doc_id", text_col="text", aligner=public_aligner) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links): groups as ``a1,a2|b1;a3|b2``, links as A id * 2^32 + B id."""
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = aligner()
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                n_a, n_b, n_groups, groups, links = zip(*each(part.column("text").to_pylist()))
                ends = np.cumsum([0, *map(len, links)]).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(links)))],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>")


def pack_bits(at: np.ndarray, size: int) -> bytes:
    """Bitmap of sorted document numbers below ``size``: one mark byte, then 16-bit numbers or plain bits."""
    if 2 * len(at) <= (size + 7) // 8:
        return b"\0" + at.astype("<u2").tobytes()
    bits = np.zeros(size, np.uint8)
    bits[at] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def popcount(data: bytes) -> int:
    if data[:1] == b"\0":
        return (len(data) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(data, np.uint8, offset=1)).sum())


def or_merge(planes: list[bytes], size: int) -> bytes:
    if len(planes) == 1:
        return planes[0]
    return pack_bits(np.unique(np.concatenate([unpack_bits(p) for p in planes])), size)


def postings(links: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """(pair, planes) of a chunk's documents, given the linked pairs of each."""
    size = len(links)
    if not size or not sum(map(len, links)):
        return
    pair = np.concatenate(links)
    doc = np.repeat(np.arange(size, dtype=np.int64), [len(x) for x in links])
    order = np.lexsort((doc, pair))
    pair, doc = pair[order], doc[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])
    times = np.diff(np.r_[new, len(pair)])
    pair, doc = pair[new], doc[new]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(pair)]):
        at, n = doc[lo:hi], times[lo:hi]
        top = int(n.max()).bit_length()
        yield int(pair[lo]), [pack_bits(at if top == 1 else at[(n >> k) & 1 == 1], size) for k in range(top)]


_DOC = "n_a:long,n_b:long,n_groups:long,groups_sha256:string"


def invert(docs: DataFrame, id_col="doc_id", text_col="text", aligner=public_aligner, chunk_docs: int = CHUNK_DOCS,
           chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(chunk, docs array<struct<doc_id, n_a, n_b, n_groups, groups_sha256>>,
    postings array<struct<pair, planes, n_docs, n_links>>), one row per chunk of aligned documents.

    groups_sha256: hex digest of the group text that ``align`` returns, empty for a document without tokens.
    """
    if not 0 < chunk_docs <= CHUNK_DOCS:
        raise ValueError(f"a chunk has 1 to {CHUNK_DOCS} documents")
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = (f"chunk long, docs array<struct<doc_id:{kind},{_DOC}>>, "
              "postings array<struct<pair:long,planes:array<binary>,n_docs:long,n_links:long>>")

    def close(number: int, ids: list, figures: list, links: list) -> pa.RecordBatch:
        found = list(postings(links))
        n_a, n_b, n_groups, digest = zip(*figures)
        kept = pa.StructArray.from_arrays(
            [pa.concat_arrays(ids), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digest, pa.string())],
            ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
        post = pa.StructArray.from_arrays(
            [pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.binary())),
             pa.array([popcount(or_merge(x, len(links))) for _, x in found], pa.int64()),
             pa.array([sum(popcount(y) << k for k, y in enumerate(x)) for _, x in found], pa.int64())],
            ["pair", "planes", "n_docs", "n_links"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
             pa.ListArray.from_arrays(pa.array([0, len(post)], pa.int32()), post)], ["chunk", "docs", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, number, ids, figures, links, held = aligner(), TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                start = 0
                for i, (n_a, n_b, n_groups, groups, linked) in enumerate(each(part.column("text").to_pylist())):
                    figures.append((n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                    links.append(linked)
                    held += len(linked)
                    if len(links) >= chunk_docs or held >= chunk_links:
                        ids.append(part.column("doc_id").slice(start, i + 1 - start))
                        yield close(number, ids, figures, links)
                        number, ids, figures, links, held, start = number + 1, [], [], [], 0, i + 1
                if start < part.num_rows:
                    ids.append(part.column("doc_id").slice(start))
        if links:
            yield close(number, ids, figures, links)

    return d.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links), corpus-wide; chunks share no document, so their counts add up."""
    p = chunks.select(F.explode("postings").alias("p")).select("p.pair", "p.n_docs", "p.n_links")
    return p.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def lexicon(counts: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, n_links, best) of ``pair_counts``: the translation table of the two vocabularies.

    best: no pair of the same B id has more links (ties included).
    """
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    top = counts.groupBy(b.alias("b_id")).agg(F.max("n_links").alias("top"))
    return (counts.withColumn("b_id", b).join(top, "b_id")
                  .select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n_docs", "n_links",
                          (F.col("n_links") == F.col("top")).alias("best")))


def score(chunks: DataFrame) -> DataFrame:
    """Each document of ``invert`` with n_links, n_best (links of a best pair) and count_sum (its links' corpus-wide counts)."""
    stash = Stash(chunks.sparkSession, "align")
    chunks = stash.put(chunks, "chunks")
    words = stash.put(lexicon(pair_counts(chunks)), "lexicon")
    mine = chunks.select(F.col("chunk").alias("to_chunk"), F.explode("postings.pair").alias("pair"))
    back = mine.join(words.select("pair", "n_links", "best"), "pair")
    fields = chunks.schema["docs"].dataType.elementType.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_links long, n_best long, count_sum long"

    def give(chunk: pa.Table, scores: pa.Table) -> pa.Table:
        """One chunk and the scores of its pairs, to a row per document."""
        docs = chunk.column("docs").combine_chunks().flatten()
        post = chunk.column("postings").combine_chunks().flatten()
        known = scores.column("pair").to_numpy()
        order = np.argsort(known)
        known, count, best = known[order], scores.column("n_links").to_numpy()[order], scores.column("best").to_numpy()[order]
        slot = np.searchsorted(known, post.field("pair").to_numpy())
        links, liked, total = (np.zeros(len(docs), np.int64) for _ in range(3))
        planes = post.field("planes")
        ends, data = planes.offsets.to_pylist(), planes.values
        for i, s in enumerate(slot.tolist()):
            c, good = int(count[s]), bool(best[s])
            for k in range(ends[i + 1] - ends[i]):
                at = unpack_bits(data[ends[i] + k].as_py())
                links[at] += 1 << k                     # numbers of one plane are distinct
                total[at] += c << k
                if good:
                    liked[at] += 1 << k
        return pa.table([*docs.flatten(), pa.array(links), pa.array(liked), pa.array(total)],
                        names=[f.name for f in fields] + ["n_links", "n_best", "count_sum"])

    return chunks.groupBy("chunk").cogroup(back.groupBy("to_chunk")).applyInArrow(give, schema)
