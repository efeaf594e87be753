"""SentencePiece BPE encoding and decoding through a merge-type prefix table.

For every prefix of a text the last token of its encoding is unique.  A token t that
ends a prefix is that last token exactly when the last token of what precedes t and t
itself stay apart under merging (a piece pair is compatible when merging the two pieces'
characters gives the two pieces back); a sequence is the encoding of its text exactly
when all neighbours are compatible.  So an automaton lists the pieces that end at each
position, one compatibility test per candidate fills the table from left to right, and
the ids are read off backwards from its end.  Work and memory are linear in the text.

The library turns spaces into U+2581 and puts one in front; characters without a piece
become one byte piece per UTF-8 byte.  Texts are encoded word by word, short words from a
cache; words end where no piece of the model reaches across (``word_pattern``).  A model
whose pieces hold a U+2581 behind another character is encoded text by text.

Defined cases: null and empty texts have no ids, and decode to the empty text; white space,
control strings such as ``<s>`` and byte names such as ``<0x0A>`` inside a text are ordinary
characters; texts are never shortened; repeated rows stay, extra columns are left out; an
empty table gives an empty result.  Decoding takes any ids of the model: bytes that are
no UTF-8 become one U+FFFD each, control ids nothing, the unknown id " ⁇ ", null the
empty text; an id outside the model raises IndexError.
"""
from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

SPACE = "▁"
CACHE_WORDS = 200_000    # entries of a task's word cache; it starts anew beyond that
CACHE_CHARS = 64         # longer words are encoded each time
CACHE_PAIRS = 300_000    # remembered compatibility tests
SLICE = 256              # documents encoded at a time
_HIGH = re.compile("[\udc80-\udcff]")


def word_pattern(pieces) -> str:
    """Pattern of stretches that no merge crosses.

    Characters that stand side by side in a piece belong together.  The largest set of such
    characters (the letters, in the public model) is never merged with any other character
    but a U+2581 before it, nor is any character with a U+2581 behind it.
    """
    if any(SPACE in x.lstrip(SPACE) for x in pieces):
        return "(?s:.+)"
    head: dict[str, str] = {}

    def find(c: str) -> str:
        while head.setdefault(c, c) != c:
            head[c] = c = head[head[c]]
        return c

    for x in pieces:
        x = x.lstrip(SPACE)
        for c, d in zip(x, x[1:]):
            head[find(c)] = find(d)
    sets: dict[str, list[str]] = {}
    for c in list(head):
        sets.setdefault(find(c), []).append(c)
    most = re.escape("".join(sorted(max(sets.values(), key=len, default=[SPACE]))))
    return f"{SPACE}*[{most}]+|{SPACE}*[^{SPACE}{most}]+|{SPACE}+"


class PieceModel:
    """A SentencePiece BPE model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = {int(names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) < 256 or sp.encode(" ﬁ  ") != sp.encode(sp.decode(sp.encode(" ﬁ  "))):
            raise ValueError("only models with byte fallback and identity normalisation are supported")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.names, self.byte_ids = names, [byte[b] for b in range(256)]
        self.ids = {names[i]: i for i in plain}
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.size = [len(x) for x in names]
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(names[i], i)
        self.automaton.make_automaton()
        self._words = re.compile(word_pattern(self.ids))
        # What a piece decodes to; bytes from 0x80 on stand as lone surrogates until runs are known.
        self.shown = [x.replace(SPACE, " ") for x in names]
        for b, i in byte.items():
            self.shown[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        for i in range(n):
            if sp.is_control(i):
                self.shown[i] = ""
            elif sp.is_unknown(i):
                self.shown[i] = " ⁇ "
        self.surface = [x.replace(SPACE, " ").encode() for x in names]      # bytes a token stands for
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        self._plain = set(plain)
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Do the pieces stay apart when they meet?  ``left`` -1: nothing that merges stands before."""
        key = left << 32 | right
        ok = self._fits.get(key)
        if ok is None:
            if len(self._fits) > CACHE_PAIRS:
                self._fits.clear()
            pair = [self.names[right]] if left < 0 else [self.names[left], self.names[right]]
            ok = self._fits[key] = self.merged("".join(pair)) == pair
        return ok

    def prefix_table(self, word: str) -> list[int]:
        """Entry i: the last token of the first i characters; -1 where that is a character without a piece."""
        last, size, known = [-1] * (len(word) + 1), self.size, self._fits
        for end, t in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = last[end - size[t]]
                ok = known.get(before << 32 | t)
                if ok or (ok is None and self.fits(before, t)):
                    last[end] = t
        return last

    def word_ids(self, word: str) -> list[int]:
        last, out, i = self.prefix_table(word), [], len(word)
        while i:
            t = last[i]
            if t < 0:
                out.extend(self.byte_ids[b] for b in reversed(word[i - 1].encode()))
                i -= 1
            else:
                out.append(t)
                i -= self.size[t]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian int32 bytes."""
        if not text:
            return b""
        cache, out = self._cache, []
        for w in self._words.findall(SPACE + text.replace(" ", SPACE)):
            ids = cache.get(w)
            if ids is None:
                ids = np.array(self.word_ids(w), "<i4").tobytes()
                if len(w) <= CACHE_CHARS:
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise IndexError(f"id {min(ids)} is not in the model")
        text = "".join(map(self.shown.__getitem__, ids))
        first = next((i for i in ids if self.shown[i]), None)
        if first in self._plain and text.startswith(" "):
            text = text[1:]
        if _HIGH.search(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "sparkclf_byte")
        return text


def _register() -> None:
    import codecs
    codecs.register_error("sparkclf_byte", lambda e: ("�", e.start + 1))


_register()


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def public_model() -> PieceModel:
    import public_tokenizers as P
    return load(P.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, id_col="doc_id", text_col="text", model=public_model, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``docs``; ``model`` is called in the tasks.

    ``decoded`` adds ``text``, decoded from the ids, in the same pass.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "ids", *(["text"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in batches:
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                found = [np.frombuffer(m.encode(t or ""), "<i4") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]).astype("<i4")
                cols = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))]
                if decoded:
                    cols.append(pa.array([m.decode(x.tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", text string" * decoded)


def decode(tokens: DataFrame, id_col="doc_id", ids_col="ids", model=public_model) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids)."""
    d = pick(tokens, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in batches:
            text = [m.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())],
                                             ["doc_id", "ids", "text"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
