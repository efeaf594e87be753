"""Quality classifier: a generalised additive model with pairwise interactions.

Text measures are computed in Arrow batches and cut into quantile bins.  Cyclic
boosting visits one measure after the other and adds, each time, a shallow tree over
its bins (two cuts at most) fitted to the logistic gradients; the sum of a measure's
trees is its lookup table.  Then the pairs with the largest remaining gain get a
two-dimensional table by boosted trees with one cut per axis.  A score is the sum of
table entries at a document's bins, through the logistic function: vectorised
additions, no tree is walked.

The model is fitted on at most ``sample_rows`` labelled rows (those with the smallest
id hashes; 20,000 by default, 18 numbers each), its only bounded input; every
document is measured and scored.  Only the text is a model input.

Defined cases: null is empty text, which is scored like any other; null labels train
nothing; without labels every score is 0.5; repeated rows get equal scores; an empty
table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, pick, small_batches

FEATURES = ("log_words", "word_length", "word_length_sd", "upper_words", "upper_chars", "digits", "symbols", "pipes", "marks",
            "stops", "commas", "unique_words", "adjacent_repeats", "top_word", "dup_lines", "line_words", "short_lines", "edge_symbols")
SAMPLE_ROWS, FOLDS, CUTOFF = 20_000, 5, 0.3
_UPPER, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>~^=_{}[]\\@+"
_EDGE = tuple("#*$%&|<>!~^=")


def _share(data: bytes, chars: bytes, n: int) -> float:
    return (len(data) - len(data.translate(None, chars))) / n


def measure(text: str) -> list[float]:
    """The measures of one whole text, in the order of FEATURES; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data, chars = text.encode("utf-8", "replace"), max(1, len(text))
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split("\n") if x.strip()]
    per_line = [len(x.split()) for x in lines]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [float(np.log1p(n)), float(size.mean()), float(size.std()), sum(map(str.isupper, words)) / n,
            _share(data, _UPPER, chars), _share(data, _DIGITS, chars), _share(data, _SYMBOLS, chars), data.count(b"|") / n,
            (data.count(b"!") + data.count(b"?")) / n, data.count(b".") / n, data.count(b",") / n, len(counts) / n,
            sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
            sum(k <= 2 for k in per_line) / len(lines), sum(w.endswith(_EDGE) for w in words) / n]


@dataclass
class Model:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)          # bin edges per measure
    tables: list[np.ndarray] = field(default_factory=list)        # one entry per bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)         # coarse bins of both measures
    coarse: list[np.ndarray] = field(default_factory=list)        # bin -> coarse bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)])

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids):
            out += g[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _gain(g, h, reg):
    return g * g / (h + reg)


def _shallow(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """Leaf values per bin of a tree with two cuts at most, from gradient and hessian sums per bin."""
    def cut(lo, hi):
        G, H = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        gains = _gain(G[:-1], H[:-1], reg) + _gain(G[-1] - G[:-1], H[-1] - H[:-1], reg) - _gain(G[-1], H[-1], reg)
        k = int(np.argmax(gains))
        return float(gains[k]), lo + k + 1

    edges = [0, len(g)]
    for _ in range(2):
        gain, at = max((cut(a, b) for a, b in zip(edges, edges[1:])), default=(0.0, 0))
        if gain <= 0:
            break
        edges = sorted({*edges, at})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + reg)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut per axis over a grid of sums."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = _gain(G[-1, -1], H[-1, -1], reg)
    a, b = G[:-1, :-1], H[:-1, :-1]
    parts = [(a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b),
             (G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b)]
    gains = sum(_gain(x, y, reg) for x, y in parts) - total
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for (x, y), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                  (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = x[i, j] / (y[i, j] + reg)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, max_bins=32, cycles=60, rate=0.2, reg=1.0, pairs=6, pair_cycles=20, coarse_bins=8) -> Model:
    """Boost lookup tables on measures x and 0/1 labels y; every argument bounds the work, none the data."""
    if not len(y):
        return Model(0.0)
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    m = Model(float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return m
    m.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, max_bins + 1)[1:-1])) for c in x.T]
    b = m.bins(x)
    n_bins = [len(c) + 1 for c in m.cuts]
    m.tables = [np.zeros(n) for n in n_bins]
    m.coarse = [np.arange(n) * coarse_bins // n for n in n_bins]
    margin = np.full(len(y), m.base)

    def slopes():
        q = 1 / (1 + np.exp(-margin))
        return y - q, q * (1 - q)

    for _ in range(cycles):
        for j, n in enumerate(n_bins):
            g, h = slopes()
            step = rate * _shallow(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n), reg)
            m.tables[j] += step
            margin += step[b[:, j]]
    grid = [m.coarse[j][b[:, j]] for j in range(len(n_bins))]
    g, h = slopes()

    def sums(i, j):
        at, shape = grid[i] * coarse_bins + grid[j], (coarse_bins, coarse_bins)
        return np.bincount(at, g, coarse_bins ** 2).reshape(shape), np.bincount(at, h, coarse_bins ** 2).reshape(shape)

    every = [(i, j) for i in range(len(n_bins)) for j in range(i)]
    m.pairs = sorted(every, key=lambda ij: (-_quadrants(*sums(*ij), reg)[0], ij))[:pairs]
    m.grids = [np.zeros((coarse_bins, coarse_bins)) for _ in m.pairs]
    for _ in range(pair_cycles):
        for k, (i, j) in enumerate(m.pairs):
            g, h = slopes()
            step = rate * _quadrants(*sums(i, j), reg)[1]
            m.grids[k] += step
            margin += step[grid[i], grid[j]]
    return m


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
          folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS, **fit_args) -> Model:
    """Fit on labelled documents outside the held-out fold (crc32 of the id's text, mod ``folds``, not 0)."""
    stash = Stash(docs.sparkSession, "gam")
    small_batches(docs.sparkSession)
    known = pick(labels, doc_id=id_col, label=label_col).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out("doc_id", folds))
    sample = stash.put(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows), "sample")
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")   # at most sample_rows rows
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, label double, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [measure(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = stash.put(rows.select("doc_id", "text", F.col("label").cast("double").alias("label")).mapInArrow(run, schema), "measures")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(sample_rows).collect()
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], dtype=float), **fit_args)


def held_out(id_col: str, folds: int = FOLDS):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", cutoff: float = CUTOFF, folds: int = FOLDS,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the carried columns, one row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), *[docs[c] for c in carry if c != id_col])
    keep = [f for f in d.schema.fields if f.name != "_text"]
    d = d.withColumn("held_out", held_out("doc_id", folds))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", held_out boolean, score double, predicted int"
    names = [f.name for f in keep] + ["held_out"]
    shared = spark.sparkContext.broadcast(model)   # lookup tables, about 20 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measure(t or "") for t in b.column("_text").to_pylist()], dtype=float).reshape(b.num_rows, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s), pa.array((s >= cutoff).astype(np.int32))],
                                             [*names, "score", "predicted"])

    return d.mapInArrow(run, out)
