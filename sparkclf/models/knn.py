"""Exact k-nearest-neighbour classification on a metric partitioning.

Train rows are dealt to cells, each around a pivot; pivots are train rows sampled by the
hash of their id.  A row's distance to its pivot is stored.  By the triangle inequality a
row t of a cell with pivot p is at least |d(q, p) - d(t, p)| away from a query q, so with
the smallest and largest stored distance of a cell a whole cell can be ruled out, and with
the stored distance of a row the row:

1. every query is compared with its own cell, which gives it k candidates and with them
   an upper bound on the distance of its k-th neighbour (where the cell has fewer rows, the
   bound comes from the nearest cells' sizes and radii);
2. the query is sent to those other cells alone whose smallest possible distance does not
   exceed the bound; there it is compared with the rows that the stored distances leave;
3. the candidates of both passes are ranked per query by distance, then train id.

Nothing is approximated: where the data leave nothing to rule out (one cell, or vectors
that are all equally far apart) every query meets every row.  A cell with very many rows
or queries is split into blocks by id, so a task holds one block of either, whatever the
share of one cell (a vector repeated a million times is one).  Pivots and cell bounds are
all that is broadcast: at most ``MAX_PIVOTS`` vectors and ``PIVOT_BYTES``.

One neighbour list of the largest k serves every smaller k, both weightings and both
metrics (the search grid is scored from one pass).
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import PARTITION_BYTES, pred_table, sorted_classes, spread

CELL_ROWS = 4096            # train rows a cell is meant to have
TRAIN_BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 8192
MAX_PIVOTS = 4096
MAX_BLOCK_TASKS = 2000
PIVOT_BYTES = 64 << 20
CHUNK_CELLS = 8_000_000      # rough distances held at once
STEP_CELLS = 1 << 17         # exact differences held at once
ROUGH_CELLS = 1 << 16
ROUGH_QUERIES = 512
QUICK_CELLS = 1 << 17        # whole-number differences held at once
QUICK_GROUP = 64             # components whose differences fit a 16-bit sum
QUICK_LEFT = 0.05            # share of a chunk's pairs beyond which the quick bounds say too little
SINGLE_MOST = 1e30           # larger values are not compared in single precision
METRICS = ("euclidean", "manhattan")
SLACK = 1e-9                # a bound is widened by this share, for rounding


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a float matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten()
    if a.null_count or flat.null_count or len(flat) % max(1, len(a)):
        raise ValueError("KNN needs vectors of one length without missing values")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(a), -1)


def distances(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``q`` to all rows of ``t``, in steps that stay in a core's cache."""
    out = np.empty((len(q), len(t)))
    width = max(1, q.shape[1])
    wide = max(1, min(len(t), STEP_CELLS // width))
    step = max(1, STEP_CELLS // (wide * width))
    for j in range(0, len(t), wide):
        for i in range(0, len(q), step):
            diff = q[i:i + step, None, :] - t[None, j:j + wide, :]
            out[i:i + step, j:j + wide] = _lengths(diff, metric)
    return out


def _lengths(diff: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(np.multiply(diff, diff, out=diff).sum(axis=-1))
    return np.abs(diff, out=diff).sum(axis=-1)


def paired_distances(q: np.ndarray, t: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (q[rows], t[cols]), as ``distances`` gives them."""
    out = np.empty(len(rows))
    step = max(1, STEP_CELLS // max(1, q.shape[1]))
    for i in range(0, len(rows), step):
        out[i:i + step] = _lengths(q[rows[i:i + step]] - t[cols[i:i + step]], metric)
    return out


class Rough:
    """Fast distances of centred rows, with bounds of their error: squared ones by a matrix product
    for the euclidean metric, sums in single precision for the manhattan one.

    ``between(q, lo, hi)`` gives (value, slack): |value - true| <= slack for a query's every row,
    where "true" is the distance (manhattan) or its square (euclidean)."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, metric: str):
        self.metric, self.centre = metric, centre
        t = x - centre
        self.size = np.abs(x).sum(axis=1).max(initial=0.0) + np.abs(centre).sum()
        if metric == "euclidean":
            self.t, self.norm = t, (t * t).sum(axis=1)
            self.far = float(np.sqrt(self.norm.max(initial=0.0)))
        else:
            self.t, self.far = np.ascontiguousarray(t.T.astype(np.float32)), float(np.abs(t).sum(axis=1).max(initial=0.0))

    def between(self, q: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        c = q - self.centre
        d = c.shape[1] + 8
        raw = 4e-16 * d * (np.abs(q).sum(axis=1) + self.size)               # lost by centring
        if self.metric == "euclidean":
            norm = (c * c).sum(axis=1)
            value = norm[:, None] + self.norm[None, lo:hi] - 2.0 * (c @ self.t[lo:hi].T)
            reach = np.sqrt(norm) + self.far
            return value, 4e-16 * d * reach * reach + 2 * raw * reach + raw * raw + 1e-300
        c32 = np.ascontiguousarray(c.T.astype(np.float32))
        value = np.zeros((len(c), hi - lo), np.float32)
        wide = max(1, min(hi - lo, ROUGH_CELLS // 8))
        step = max(1, ROUGH_CELLS // wide)
        for j in range(lo, hi, wide):
            e = min(hi, j + wide)
            for i in range(0, len(c), step):
                part = np.zeros((min(step, len(c) - i), e - j), np.float32)
                gap = np.empty_like(part)
                for a in range(c.shape[1]):
                    np.subtract(c32[a, i:i + step, None], self.t[a][None, j:e], out=gap)
                    part += np.abs(gap, out=gap)
                value[i:i + step, j - lo:e - lo] = part
        return value, 1.2e-7 * d * (np.abs(c).sum(axis=1) + self.far) + raw + 1e-30

    def limit(self, bound: np.ndarray) -> np.ndarray:
        """A bound on distances, in the unit of ``between``."""
        return bound * bound * (1 + SLACK) if self.metric == "euclidean" else bound


class Quick:
    """Lower bounds of distances in two or four bytes a pair: of query i to row t they say that t can be
    within a bound only where ``values`` is not above ``limit``.

    Euclidean: a matrix product in single precision.  Manhattan: sums of whole numbers on a grid over the
    middle of the rows.  What a row loses on the grid is subtracted from its sums; rows that lose too much
    are never ruled out.  Where a query leaves the grid, it does so for every row alike.
    """

    def __init__(self, x: np.ndarray, q: np.ndarray, centre: np.ndarray, metric: str):
        self.metric, self.dims = metric, x.shape[1]
        self.lost = 4e-16 * (self.dims + 8)               # of double precision
        size = np.abs(x).sum(axis=1).max(initial=0.0) + np.abs(centre).sum()
        if metric == "euclidean":
            t, c = x - centre, q - centre
            most = max(np.abs(t).max(initial=0.0), np.abs(c).max(initial=0.0))
            self.unit = 2.0 ** np.ceil(np.log2(most)) if most > 1e-140 else 1.0      # smaller squares are lost
            t, c = t / self.unit, c / self.unit
            self.norm, self.own = (t * t).sum(axis=1), (c * c).sum(axis=1)
            self.t = np.vstack([-2.0 * t.T, self.norm]).astype(np.float32)
            self.q = np.column_stack([c, np.ones(len(c))]).astype(np.float32)
            self.raw = self.lost * (np.abs(q).sum(axis=1) + size) / self.unit
            return
        levels = 32767 // max(1, min(self.dims, QUICK_GROUP))
        low, high = np.quantile(x, [0.001, 0.999], axis=0)
        if not (high > low).any():
            low, high = x.min(axis=0), x.max(axis=0)
        self.unit = max((high - low).max(initial=0.0) / levels, 1e-250)
        base = (low + high) / 2 - levels * self.unit / 2
        self.kind = np.int16 if self.dims <= QUICK_GROUP else np.int32
        self.bottom = np.iinfo(self.kind).min

        def grid(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            inside = np.clip(v, base, base + levels * self.unit)
            n = np.clip(np.rint((inside - base) / self.unit), 0, levels)
            return np.ascontiguousarray(n.T.astype(np.int16)), inside, base + n * self.unit

        self.t, _, at = grid(x)
        least = np.ceil(np.abs(x - at).sum(axis=1) / self.unit) + 1
        self.always = least > -(self.bottom // 2 if self.dims > QUICK_GROUP else self.bottom + 1)
        self.less = np.where(self.always, 0, least).astype(self.kind)
        self.q, inside, at = grid(q)
        self.out = np.abs(q - inside).sum(axis=1) - np.abs(inside - at).sum(axis=1)
        self.raw = self.lost * (np.abs(q).sum(axis=1) + size + np.abs(base).sum() + levels * self.unit * self.dims)

    def values(self, some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        if self.metric == "euclidean":
            return self.q[some] @ self.t[:, lo:hi]
        q, t, value = np.ascontiguousarray(self.q[:, some]), self.t[:, lo:hi], np.empty((len(some), hi - lo), self.kind)
        step = max(1, QUICK_CELLS // max(1, hi - lo))
        gap = np.empty((step, hi - lo), np.int16)
        for i in range(0, len(some), step):
            whole = value[i:i + step]
            whole[:] = -self.less[None, lo:hi]
            for a in range(0, self.dims, QUICK_GROUP):
                part = whole if self.kind is np.int16 else np.zeros(whole.shape, np.int16)
                for b in range(a, min(a + QUICK_GROUP, self.dims)):
                    one = gap[:len(whole)]
                    np.subtract(q[b, i:i + step, None], t[b][None, :], out=one)
                    np.add(part, np.abs(one, out=one), out=part)
                if part is not whole:
                    whole += part
        value[:, np.flatnonzero(self.always[lo:hi])] = self.bottom
        return value

    def limit(self, some: np.ndarray, lo: int, hi: int, bound: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if self.metric == "euclidean":
                far, own = float(np.sqrt(self.norm[lo:hi].max(initial=0.0))), np.sqrt(self.own[some])
                slack = 7e-8 * (self.dims + 8) * far * (2 * own + far) + self.lost * (own + far) ** 2 + 1e-36 * (self.dims + 1)
                slack += self.raw[some] * (2 * (own + far) + self.raw[some])
                square = (bound / self.unit) ** 2 * (1 + SLACK) - self.own[some] + slack
                return np.nextafter(square.astype(np.float32), np.float32(np.inf))
            most = np.floor((bound + self.raw[some] - self.out[some]) / self.unit) + 1
        return np.clip(most, self.bottom, np.iinfo(self.kind).max).astype(self.kind)


def first_copies(x: np.ndarray, tid: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of the rows that can be among k nearest ones: of equal vectors the k with the smallest ids."""
    order = np.lexsort((tid, *x.T[::-1])) if x.shape[1] else np.argsort(tid, kind="stable")
    s = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return np.sort(order[np.arange(len(x)) - start < k])


@dataclass
class Cells:
    """Pivots, and per metric the rows and the smallest and largest stored distance of each cell."""
    pivots: np.ndarray
    count: dict | None = None
    low: dict | None = None
    high: dict | None = None

    def to_pivots(self, x: np.ndarray, metric: str) -> np.ndarray:
        return distances(x, self.pivots, metric)

    def home(self, d: np.ndarray, metric: str) -> np.ndarray:
        """The nearest cell that has rows."""
        return np.where(self.count[metric] > 0, d, np.inf).argmin(axis=1)

    def first_bound(self, d: np.ndarray, metric: str, k: int) -> np.ndarray:
        """Upper bound of the k-th distance from cell sizes and radii alone."""
        far = np.where(self.count[metric] > 0, d + self.high[metric], np.inf)
        order = np.argsort(far, axis=1)
        have = np.cumsum(self.count[metric][order], axis=1) >= k
        at = np.where(have.any(axis=1), have.argmax(axis=1), 0)
        found = np.take_along_axis(far, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
        return np.where(have.any(axis=1), found, np.inf)

    def lower(self, d: np.ndarray, metric: str) -> np.ndarray:
        """Least possible distance to a row of each cell."""
        gap = np.maximum(np.maximum(d - self.high[metric], self.low[metric] - d), 0.0)
        return np.where(self.count[metric] > 0, gap, np.inf)


def choose_pivots(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """Vectors of the sampled rows (those with the smallest id hashes), as many as cells are wanted and fit."""
    most = max(1, PIVOT_BYTES // (8 * max(1, dims)))
    want = min(max(1, math.ceil(n / CELL_ROWS)), MAX_PIVOTS, most)
    got = (rows.select("x", F.xxhash64("tid").alias("h")).orderBy("h").limit(want).toArrow()).column("x")
    return np.unique(_matrix(got), axis=0)


def deal(rows: DataFrame, cells: Cells, metrics) -> DataFrame:
    """(metric, cell, pd, ...): every train row beside its nearest pivot, per metric, with the distance to it."""
    names = rows.columns
    schema = "metric string, cell int, pd double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"))
            for m in metrics if len(x) else ():
                d = cells.to_pivots(x, m)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(x)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]),
                     *(b.column(c) for c in names)], ["metric", "cell", "pd", *names])

    return rows.mapInArrow(run, schema)


def measure(dealt: DataFrame, cells: Cells, metrics) -> Cells:
    """Cell sizes and distance bounds: at most pivots x metrics rows."""
    n = len(cells.pivots)
    cells.count = {m: np.zeros(n, np.int64) for m in metrics}
    cells.low = {m: np.full(n, np.inf) for m in metrics}
    cells.high = {m: np.full(n, -np.inf) for m in metrics}
    for r in dealt.groupBy("metric", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("pd").alias("lo"), F.max("pd").alias("hi")).collect():
        cells.count[r["metric"]][r["cell"]] = r["n"]
        cells.low[r["metric"]][r["cell"]] = r["lo"]
        cells.high[r["metric"]][r["cell"]] = r["hi"]
    return cells


def route(queries: DataFrame, cells: Cells, metrics, k: int, bounds: bool) -> DataFrame:
    """(metric, cell, qid, x, bound): without ``bounds`` each query's own cell; with them - ``queries`` then has
    (metric, qid, x, bound) - the other cells that may hold a neighbour within the bound."""
    qt = queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            asked = np.array(b.column("metric").to_pylist()) if bounds else None
            for m in metrics:
                at = np.flatnonzero(asked == m) if bounds else np.arange(len(x))
                if not len(at):
                    continue
                d = cells.to_pivots(x[at], m)
                home = cells.home(d, m)
                bound = cells.first_bound(d, m, k)
                if bounds:
                    known = b.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)[at]
                    bound = np.fmin(bound, known)                     # null is NaN: no bound from the own cell
                    near = cells.lower(d, m) <= (bound * (1 + SLACK) + 1e-300)[:, None]
                    near &= cells.count[m] > 0
                    near[np.arange(len(at)), home] = False
                    row, cell = np.nonzero(near)
                else:
                    row, cell = np.arange(len(at)), home
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(row), pa.string()), pa.array(cell.astype(np.int32)), b.column("qid").take(take),
                     b.column("x").take(take), pa.array(bound[row])], ["metric", "cell", "qid", "x", "bound"])

    return queries.mapInArrow(run, f"metric string, cell int, qid {qt}, x array<double>, bound double")


def _nearest(t: pa.Table, q: pa.Table, cells: Cells, k: int) -> pa.Table:
    """Candidates of one block of train rows for one block of queries of a cell."""
    metric, cell = q.column("metric")[0].as_py(), q.column("cell")[0].as_py()
    t = t.take(pc.sort_indices(t.column("pd")))
    x = _matrix(t.column("x"))
    tid = pc.rank(t.column("tid").combine_chunks(), tiebreaker="dense").to_numpy()
    kept = first_copies(x, tid, k)
    if len(kept) < len(x):
        t, x, tid = t.take(pa.array(kept)), x[kept], tid[kept]
    pd_ = t.column("pd").to_numpy()
    qx, bound = _matrix(q.column("x")), q.column("bound").to_numpy() * (1 + SLACK) + 1e-300
    d = distances(qx, cells.pivots[cell:cell + 1], metric)[:, 0]
    low, high = np.searchsorted(pd_, d - bound, side="left"), np.searchsorted(pd_, d + bound, side="right")
    by_place = np.argsort(low, kind="stable")          # queries that need the same rows go together
    tame = max(np.abs(x).max(initial=0.0), np.abs(qx).max(initial=0.0)) < SINGLE_MOST
    quick, rough = Quick(x, qx, cells.pivots[cell], metric) if tame else None, None
    step = max(1, min(ROUGH_QUERIES, CHUNK_CELLS // max(1, len(x))))
    rows, cols, far = [], [], []
    for i in range(0, len(by_place), step):
        some = by_place[i:i + step]
        lo, hi = int(low[some].min()), int(high[some].max())
        if lo >= hi:
            continue
        if quick is None:
            dist = distances(qx[some], x[lo:hi], metric)
            kq = min(k, hi - lo)
            r, c = np.nonzero(dist <= np.minimum(np.partition(dist, kq - 1, axis=1)[:, kq - 1], bound[some])[:, None])
            real = dist[r, c]
        else:
            left, within = _left(quick, qx, x, some, lo, hi, bound[some], k, metric)
            r, c = np.divmod(np.flatnonzero(left), hi - lo)
            if len(r) > max(QUICK_LEFT * left.size, 4 * k * len(some)):
                rough = rough or Rough(x, cells.pivots[cell], metric)
                near, slack = rough.between(qx[some], lo, hi)
                limit = rough.limit(within) + slack
                many = np.flatnonzero((near <= limit[:, None]).sum(axis=1) > k)
                if len(many):                              # the k-th rough distance bounds them closer
                    limit[many] = np.minimum(limit[many], np.partition(near[many], k - 1, axis=1)[:, k - 1] + 2 * slack[many])
                r, c = np.nonzero(near <= limit[:, None])
            real = paired_distances(qx, x, some[r], lo + c, metric)
            keep = real <= within[r]
            r, c, real = r[keep], c[keep], real[keep]
        o = np.lexsort((tid[lo + c], real, r))
        r, c, real = r[o], c[o], real[o]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(some[r[first]])
        cols.append(lo + c[first])
        far.append(real[first])
    rows, cols, far = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols, far))
    return pa.table({"metric": pa.array([metric] * len(rows), pa.string()), "qid": q.column("qid").take(pa.array(rows)),
                     "tid": t.column("tid").take(pa.array(cols)), "label": t.column("label").take(pa.array(cols)),
                     "dist": pa.array(far.astype(np.float64))})


def _left(quick: Quick, qx: np.ndarray, x: np.ndarray, some: np.ndarray, lo: int, hi: int, bound: np.ndarray, k: int,
          metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the quick bounds leave, and the bounds: where many are left, the k nearest by the quick ones give a closer bound."""
    near = quick.values(some, lo, hi)
    left = near <= quick.limit(some, lo, hi, bound)[:, None]
    many = np.flatnonzero(np.count_nonzero(left, axis=1) > 4 * k)
    if len(many):
        top = np.argpartition(near[many], k - 1, axis=1)[:, :k]
        real = paired_distances(qx, x, np.repeat(some[many], k), lo + top.ravel(), metric).reshape(-1, k).max(axis=1)
        bound = bound.copy()
        bound[many] = np.minimum(bound[many], real * (1 + SLACK) + 1e-300)
        left[many] = near[many] <= quick.limit(some[many], lo, hi, bound[many])[:, None]
    return left, bound


def _compare(dealt: DataFrame, routed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Top-k candidates (metric, qid, tid, label, dist) of routed queries, per block of their cells."""
    spark = dealt.sparkSession
    asked = routed.groupBy("metric", "cell").agg(F.count(F.lit(1)).alias("n")).collect()      # <= pivots x metrics rows
    sizes = [(r["metric"], r["cell"], math.ceil(int(cells.count[r["metric"]][r["cell"]]) / TRAIN_BLOCK_ROWS),
              math.ceil(r["n"] / QUERY_BLOCK_ROWS)) for r in asked]
    blocks = F.broadcast(spark.createDataFrame(sizes, "metric string, cell int, tblocks int, qblocks int"))
    t = (dealt.join(blocks, ["metric", "cell"])
              .withColumn("tb", F.pmod(F.xxhash64("tid"), F.col("tblocks")).cast("int"))
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1))).drop("tblocks", "qblocks"))
    q = (routed.join(blocks, ["metric", "cell"])
               .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("qblocks")).cast("int"))
               .withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tblocks") - 1))).drop("tblocks", "qblocks"))
    types = {f.name: f.dataType.simpleString() for f in [*dealt.schema, *routed.schema]}
    schema = f"metric string, qid {types['qid']}, tid {types['tid']}, label {types['label']}, dist double"
    empty = _arrow_schema(spark, schema)

    def block(tt: pa.Table, qq: pa.Table) -> pa.Table:
        return _nearest(tt, qq, cells, k) if tt.num_rows and qq.num_rows else empty.empty_table()

    # Blocks are much work for few bytes: they are dealt to as many partitions as there are blocks (up to
    # MAX_BLOCK_TASKS), which Spark would otherwise join into a few by their bytes.
    keys = ["metric", "cell", "tb", "qb"]
    parts = max(1, min(MAX_BLOCK_TASKS, sum(a * b for _, _, a, b in sizes)))
    t, q = (x.repartition(parts, *keys) for x in (t, q))
    return t.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(block, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("metric", "qid").orderBy("dist", "tid")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prepare(train: DataFrame, features: str, id_col: str, label: str, metrics=METRICS) -> tuple[DataFrame, Cells] | None:
    """The dealt train rows and their cells; None for an empty table."""
    rows = train.select(F.col(id_col).alias("tid"), F.col(label).alias("label"), F.col(features).cast("array<double>").alias("x"))
    rows = rows.persist()                  # counted, sampled and dealt
    try:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
        if not size["n"]:
            return None
        cells = Cells(choose_pivots(rows, size["n"], size["d"]))
        dealt = cut_lineage(deal(spread(rows, size["n"], size["d"]), cells, metrics))
    finally:
        rows.unpersist()
    return dealt, measure(dealt, cells, metrics)


def neighbours(train: DataFrame, query: DataFrame, features: str, id_col: str, label: str,
               k: int, metrics=METRICS) -> DataFrame:
    """(metric, qid, tid, label, dist, rank) for the k nearest train rows of every query row."""
    metrics = tuple(dict.fromkeys(metrics))
    q = query.select(F.col(id_col).alias("qid"), F.col(features).cast("array<double>").alias("x"))
    ready = prepare(train, features, id_col, label, metrics)
    if ready is None:
        types = [train.schema[c].dataType.simpleString() for c in (id_col, label)]
        return query.sparkSession.createDataFrame(
            [], f"metric string, qid {q.schema['qid'].dataType.simpleString()}, tid {types[0]}, label {types[1]}, dist double, rank int")
    dealt, cells = ready
    asked, width = q.count(), len(cells.pivots[0])
    q = cut_lineage(spread(q, asked, width))                                        # routed, counted and compared from here
    own = _ranked(_compare(dealt, route(q, cells, metrics, k, bounds=False), cells, k), k)
    if len(cells.pivots) == 1:
        return own                                               # there is no other cell
    own = cut_lineage(own)
    kth = own.where(F.col("rank") == k).select(F.col("metric").alias("_m"), F.col("qid").alias("_q"), F.col("dist").alias("bound"))
    wide = q.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    wide = wide.join(kth, (F.col("metric") == F.col("_m")) & (F.col("qid") == F.col("_q")), "left").select("metric", "qid", "x", "bound")
    # where nothing can be ruled out, a query is written once for every cell: tasks are dealt by those bytes
    sent = -(-asked * len(metrics) * len(cells.pivots) * width * 8 // PARTITION_BYTES)
    wide = wide.repartition(max(q.rdd.getNumPartitions(), min(MAX_BLOCK_TASKS, sent)))
    more = _compare(dealt, cut_lineage(route(wide, cells, metrics, k, bounds=True)), cells, k)
    return _ranked(own.drop("rank").unionByName(more), k)


def vote(nb: DataFrame, classes: list, k: int, weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    """(qid, y_pred, scores) from a neighbour list: uniform or inverse-distance
    weights (a query with zero-distance neighbours lets only those vote);
    ties go to the smallest class; scores are vote shares in class order."""
    sel = nb.where((F.col("metric") == metric) & (F.col("rank") <= k))
    if weights == "distance":
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("qid"))
        sel = sel.withColumn("w", F.when(zero == 1, (F.col("dist") == 0).cast("double"))
                             .otherwise(1.0 / F.col("dist")))
    else:
        sel = sel.withColumn("w", F.lit(1.0))
    v = sel.groupBy("qid", "label").agg(F.sum("w").alias("w"))
    agg = v.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("mp"),
                               F.sum("w").alias("tot"))
    scores = F.array(*[F.coalesce(F.element_at(F.col("mp"), F.lit(c)), F.lit(0.0)) / F.col("tot")
                       for c in classes])
    # first maximum in sorted class order
    best = F.array_max(F.col("scores"))
    pred = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(F.col("scores"), best).cast("int"))
    return agg.select("qid", scores.alias("scores")).select("qid", pred.alias("y_pred"), "scores")


@dataclass
class KNNModel:
    train: DataFrame
    features: str
    id_col: str
    label: str
    classes: list
    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"

    def predict(self, df: DataFrame, name: str = "K-Nearest Neighbors", nb: DataFrame | None = None) -> DataFrame:
        """``nb``: a neighbour list of ``df`` with this metric and at least k ranks, where one exists already."""
        if nb is None:
            nb = neighbours(self.train, df, self.features, self.id_col, self.label, self.k, (self.metric,))
        v = vote(nb, self.classes, self.k, self.weights, self.metric)
        j = df.select(F.col(self.id_col).alias("qid"), F.col(self.label).alias("__y")).join(v, "qid", "left")
        return pred_table(j, "qid", "__y", F.col("y_pred"), F.col("scores"), name)


def fit_knn(train: DataFrame, features: str, id_col: str, label: str, k: int = 5, weights: str = "uniform",
            metric: str = "euclidean") -> KNNModel:
    """KNN is lazy: fitting keeps the (labelled) train rows and the class list."""
    tr = train.where(F.col(label).isNotNull())
    return KNNModel(tr, features, id_col, label, sorted_classes(tr, label), k, weights, metric)
