"""Many linear models in one scan per iteration.

A search fits the same kind of model for every (candidate, fold).  Fitting them one
by one reads the data once per iteration and model; here one pass adds up the losses
and gradients of all of them (a matrix product per Arrow batch), and the driver, which
holds nothing but weights, takes one L-BFGS step per model.  A model leaves out the
rows of its fold, which are then its validation rows.

Behind a landmark map z = k(x, landmarks) · M a margin is k · (M w) and a gradient M' (k' slope):
the tasks see k alone, taken once per row and kernel of an open model, and M, a square of the
landmarks, is applied on the driver once per pass and not to every row.

Objectives are those of Spark ML's estimators: mean loss + reg / 2 * |w|^2 with a free
intercept; logistic loss (softmax for more than two classes), or the hinge loss,
rounded off over ``HINGE_WIDTH`` below its corner, one against the rest.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .nystroem import kernel_values, square_distances

HINGE_WIDTH = 0.05
MEMORY, MAX_PASSES, TOLERANCE = 10, 250, 1e-5
CHUNK_ROWS = 2048        # rows whose kernel values are held at once
DIRECT_PARTIALS = 64     # partial sums that go straight to the driver; more are added up on the way


@dataclass
class LinearTask:
    loss: str              # 'logistic' or 'hinge'
    reg: float
    fold: int              # rows left out (-1: none)
    map_id: int = 0        # which feature map


def _features(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _chunks(batches):
    """(x, y, fold) of some ``CHUNK_ROWS`` rows at a time."""
    for b in batches:
        if b.num_rows:
            x = _features(b, "x")
            y = b.column("y").to_numpy(zero_copy_only=False).astype(int)
            fold = b.column("fold").to_numpy(zero_copy_only=False).astype(int)
            for lo in range(0, len(x), CHUNK_ROWS):
                at = slice(lo, lo + CHUNK_ROWS)
                yield x[at], y[at], fold[at]


def _kernels(maps, needed):
    """What tasks need of the maps: (distinct landmark sets, {map: None or (landmark set, gamma)})."""
    points, of = [], {}
    for m in needed:
        if maps[m] is None:
            of[m] = None
            continue
        at = next((i for i, p in enumerate(points) if np.array_equal(p, maps[m].landmarks)), len(points))
        if at == len(points):
            points.append(maps[m].landmarks)
        of[m] = (at, maps[m].gamma)
    return points, of


def _bases(x, kernels):
    """{map: x itself, or its kernel values}; maps with the same landmarks share the distances."""
    points, of = kernels
    far = [square_distances(x, p) for p in points]
    return {m: x if k is None else kernel_values(far[k[0]], k[1]) for m, k in of.items()}


def _on_base(w, m):
    """Weights (..., dims + 1) of a map's outputs as weights of its base."""
    return w if m is None else np.concatenate([w[..., :-1] @ m.weights.T, w[..., -1:]], axis=-1)


def _margins(z, w):
    """(rows, tasks, outputs) of weights (tasks, outputs, dims + 1), the intercept last."""
    t, k, d = w.shape
    flat = w.reshape(t * k, d)
    return (z @ flat[:, :-1].T + flat[:, -1]).reshape(len(z), t, k)


def _losses(kind, margin, y, classes):
    """Loss (rows, tasks) and its slope (rows, tasks, outputs)."""
    k = margin.shape[2]
    if kind == "logistic" and k > 1:
        m = margin - margin.max(2, keepdims=True)
        e = np.exp(m)
        p = e / e.sum(2, keepdims=True)
        hot = np.eye(k)[y][:, None, :]
        return -np.log(np.maximum((p * hot).sum(2), 1e-300)), p - hot
    sign = np.where(y[:, None] == (np.arange(k) if k > 1 else np.array([classes - 1])), 1.0, -1.0)[:, None, :]
    t = sign * margin
    if kind == "logistic":
        return np.logaddexp(0.0, -t).sum(2), -sign / (1 + np.exp(np.clip(t, -700, 700)))
    gap = 1 - t
    loss = np.where(gap <= 0, 0.0, np.where(gap < HINGE_WIDTH, gap * gap / (2 * HINGE_WIDTH), gap - HINGE_WIDTH / 2))
    return loss.sum(2), -sign * np.clip(gap / HINGE_WIDTH, 0.0, 1.0)


def _outputs(kind: str, classes: int) -> int:
    return 1 if classes <= 2 else classes


def _sum_arrays(data: DataFrame, fn, schema="s binary") -> list[np.ndarray]:
    """Sum over partitions of the float arrays that ``fn`` makes of a partition's batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fn(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in b.column("s").to_pylist():
                total = np.frombuffer(s) if total is None else total + np.frombuffer(s)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    part = data.mapInArrow(run, schema)
    n = data.rdd.getNumPartitions()
    while n > DIRECT_PARTIALS:
        n = int(np.ceil(np.sqrt(n)))
        part = part.repartition(n).mapInArrow(add, schema)
    return sum((np.frombuffer(r["s"]) for r in part.collect()), np.zeros(1))


class _Lbfgs:
    """One model's optimiser: proposes a point, is told value and gradient there."""

    def __init__(self, size: int):
        self.w, self.f, self.g = np.zeros(size), None, None
        self.s, self.y, self.step, self.way = [], [], 1.0, np.zeros(size)
        self.done, self.tries = False, 0

    def point(self):
        return self.w if self.f is None else self.w + self.step * self.way

    def told(self, f, g):
        if self.f is not None:
            if f > self.f + 1e-4 * self.step * (self.g @ self.way) and self.tries < 20:
                self.step, self.tries = self.step / 2, self.tries + 1
                return
            new = self.point()
            s, y = new - self.w, g - self.g
            if s @ y > 1e-12:
                self.s, self.y = [*self.s, s][-MEMORY:], [*self.y, y][-MEMORY:]
            if f > self.f or abs(self.f - f) <= TOLERANCE * 1e-2 * max(1.0, abs(f)):
                self.done = True
            if f <= self.f:
                self.w, self.f, self.g = new, f, g
        else:
            self.f, self.g = f, g
        if np.linalg.norm(self.g) <= TOLERANCE * max(1.0, np.linalg.norm(self.w)):
            self.done = True
        q, alphas = self.g.copy(), []
        for s, y in zip(reversed(self.s), reversed(self.y)):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if self.s:
            q *= (self.s[-1] @ self.y[-1]) / (self.y[-1] @ self.y[-1])
        for (s, y), a in zip(zip(self.s, self.y), reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        self.way, self.tries = -q, 0
        self.step = 1.0 if self.s else min(1.0, 1.0 / max(1e-12, np.linalg.norm(self.g)))


def fit_many(data: DataFrame, tasks: list[LinearTask], maps: list, dims: list[int], classes: int, fold_rows: dict[int, int]) -> list[np.ndarray]:
    """Weights (outputs, dims + 1) per task.  data: (x array<double>, y int, fold int), best persisted."""
    total = sum(fold_rows.values())
    rows = [max(1, total - fold_rows.get(t.fold, 0)) for t in tasks]
    shapes = [(_outputs(t.loss, classes), dims[t.map_id] + 1) for t in tasks]
    opts = [_Lbfgs(k * d) for k, d in shapes]
    spark = data.sparkSession
    for _ in range(MAX_PASSES):
        live = [i for i, o in enumerate(opts) if not o.done]
        if not live:
            break
        groups: dict = {}
        for i in live:
            groups.setdefault((tasks[i].loss, tasks[i].map_id), []).append(i)
        plan = [(loss, m, _on_base(np.stack([opts[i].point().reshape(shapes[i]) for i in idx]), maps[m]), np.array([tasks[i].fold for i in idx]))
                for (loss, m), idx in groups.items()]
        sent = spark.sparkContext.broadcast((plan, _kernels(maps, dict.fromkeys(m for _, m in groups))))     # weights of the open models

        def partial(batches):
            sums = None
            for x, y, fold in _chunks(batches):
                plan, kernels = sent.value
                bases, out = _bases(x, kernels), []
                for loss, m, w, left_out in plan:
                    use = (fold[:, None] != left_out[None, :]).astype(float)
                    value, slope = _losses(loss, _margins(bases[m], w), y, classes)
                    slope = (slope * use[:, :, None]).reshape(len(y), -1)
                    out += [(value * use).sum(0), np.column_stack([slope.T @ bases[m], slope.sum(0)]).ravel()]
                flat = np.concatenate(out)
                sums = flat if sums is None else sums + flat
            return sums

        got, at = _sum_arrays(data, partial), 0
        sent.unpersist()
        for (loss, m), idx in groups.items():
            values, at = got[at:at + len(idx)], at + len(idx)
            for n, i in enumerate(idx):
                size = shapes[i][0] * (shapes[i][1] if maps[m] is None else len(maps[m].landmarks) + 1)
                g = got[at:at + size].reshape(shapes[i][0], -1) / rows[i]
                at += size
                g = g.ravel() if maps[m] is None else np.column_stack([g[:, :-1] @ maps[m].weights, g[:, -1]]).ravel()
                w = opts[i].point().reshape(shapes[i]).copy()
                w[:, -1] = 0.0                        # the intercept is free
                f = values[n] / rows[i] + tasks[i].reg / 2 * (w * w).sum()
                opts[i].told(f, g + tasks[i].reg * w.ravel())
    return [o.w.reshape(s) for o, s in zip(opts, shapes)]


def held_out_confusion(data: DataFrame, tasks: list[LinearTask], weights: list[np.ndarray], maps: list, classes: int) -> np.ndarray:
    """(task, true, predicted) counts over each task's left-out rows, in one pass."""
    plan = [(t.fold, t.map_id, _on_base(w, maps[t.map_id])) for t, w in zip(tasks, weights)]
    sent = data.sparkSession.sparkContext.broadcast((plan, _kernels(maps, dict.fromkeys(t.map_id for t in tasks))))

    def partial(batches):
        counts = np.zeros((len(sent.value[0]), classes, classes))
        for x, y, fold in _chunks(batches):
            plan, kernels = sent.value
            bases = _bases(x, kernels)
            for i, (left_out, m, w) in enumerate(plan):
                at = np.flatnonzero(fold == left_out)
                p = bases[m][at] @ w[:, :-1].T + w[:, -1]
                p = (p[:, 0] > 0).astype(int) if w.shape[0] == 1 else p.argmax(1)
                np.add.at(counts[i], (y[at], np.minimum(p, classes - 1)), 1)
        return counts.ravel()

    return _sum_arrays(data, partial).reshape(len(tasks), classes, classes)


def score_confusion(counts: np.ndarray, primary: str) -> float:
    """Accuracy or support-weighted F1 of one confusion matrix (true, predicted)."""
    n = counts.sum()
    if not n:
        return float("nan")
    if primary == "accuracy":
        return float(np.trace(counts) / n)
    true, said, hit = counts.sum(1), counts.sum(0), np.diag(counts)
    f1 = np.divide(2 * hit, true + said, out=np.zeros(len(hit)), where=true + said > 0)
    return float((true * f1).sum() / n)
