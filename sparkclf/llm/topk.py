"""Exact top-k search by inner product with an M-tree.

Vectors are integers, floor(scale * x).  Inner product is turned into a metric by one
more coordinate, sqrt(M^2 - |x|^2) with M the largest norm: then the squared Euclidean
distance from a query (coordinate 0) is |q|^2 + M^2 - 2 * score, so the nearest rows
are those with the highest scores.

Index: at most ``MAX_ROUTERS`` rows with the smallest id hashes are routing objects;
every row goes to its nearest one, and a region is split by hash into subtrees of about
``SUBTREE_ROWS`` rows, so a region that holds a third of all rows (equal vectors too)
is spread.  A subtree is built in one task: its rows are paged into leaves of
``PAGE_ROWS`` around page routers.  A node stores its covering radius and its
distance to its parent, an entry its distance to its page's router.

Search: a query is first searched in the subtree it lies in itself, which gives a bound on its
k-th score (the scores against the routing objects give a first one).  Then it is sent to
those regions only whose covering radius leaves room for a score at that bound, and from there
to their subtrees, in blocks of queries.  Inside a subtree pages are opened best first, by the
lower bound d(q, router) - radius, a growing number at a time, until no bound can beat
the k-th score; page distances and entry scores are not computed where the stored
distances already rule them out.  Bounds are kept half a unit wide, so integer scores,
ties included, are exact.

Defined cases: null vectors and vectors with null or non-finite components take no
part; shorter vectors count as padded with 0; a row is never its own candidate, and
rows that share an id are different rows; fewer rows than k give fewer ranks;
components are expected within 2^24 after scaling.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Stash, pick

MAX_ROUTERS, REGION_ROWS, SUBTREE_ROWS, PAGE_ROWS, BLOCK_QUERIES = 512, 4096, 4096, 64, 2048


def quantised(vectors: DataFrame, id_col="vec_id", vec_col="embedding", scale: int = 256) -> DataFrame:
    """(vec_id, copy, v): integer vectors of the rows that take part; copy tells rows of one id apart."""
    d = pick(vectors, vec_id=id_col, v=vec_col).withColumn("v", F.col("v").cast("array<double>"))
    big = float("inf")
    d = d.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()
                 & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(big))))
    d = d.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.row_number().over(W.partitionBy("vec_id").orderBy("v")).alias("copy"))


def _matrix(values, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0.0))


def _subtree(ids, copies, x: np.ndarray, top: float) -> list[tuple]:
    """Leaf pages of one subtree: (page router, radius, distance to parent, members, entry distances, parent, parent radius)."""
    lifted = _lift(x, top)
    parent = lifted[0]
    seeds = np.linspace(0, len(x) - 1, -(-len(x) // PAGE_ROWS)).astype(int)
    near = _distances(lifted, lifted[seeds]).argmin(1)
    order, pages = np.argsort(near, kind="stable"), []
    for s in np.unique(near):
        own = order[np.searchsorted(near[order], s):np.searchsorted(near[order], s, "right")]
        for lo in range(0, len(own), PAGE_ROWS):
            at = own[lo:lo + PAGE_ROWS]
            router = lifted[at[0]] if lo else lifted[seeds[s]]
            dist = np.linalg.norm(lifted[at] - router, axis=1)
            pages.append((router, dist.max(), float(np.linalg.norm(router - parent)), at, dist))
    radius = float(np.linalg.norm(lifted - parent, axis=1).max())
    return [(p, parent, radius) for p in pages]


def place(rows: DataFrame, dim: int, top: float, routers: np.ndarray) -> DataFrame:
    """``rows`` with the region of the nearest routing object and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(_lift(routers, top))

    def region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dist = _distances(_lift(_matrix(b.column("v").to_pylist(), dim), top), shared.value)
            near = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int64)), pa.array(dist[np.arange(len(near)), near])],
                                             [*b.schema.names, "region", "far"])

    return rows.mapInArrow(region, "vec_id long, v array<long>, copy int, region long, far double")


def index(placed: DataFrame, dim: int, top: float) -> DataFrame:
    """Leaf pages of the whole tree, one row each."""
    schema = ("region long, part long, parent binary, parent_radius double, router binary, radius double, to_parent double, "
              "ids array<long>, copies array<int>, vectors binary, entry_dist binary")

    def build(key, pdf):
        x = _matrix(pdf["v"], dim)
        ids, copies = pdf["vec_id"].to_numpy(), pdf["copy"].to_numpy()
        return pd.DataFrame([(key[0], key[1], parent.tobytes(), parent_radius, router.tobytes(), radius, to_parent, ids[at], copies[at],
                              x[at].astype("<i4").tobytes(), dist.tobytes())
                             for (router, radius, to_parent, at, dist), parent, parent_radius in _subtree(ids, copies, x, top)],
                            columns=[c.split()[0] for c in schema.split(", ")])

    return placed.groupBy("region", "part").applyInPandas(build, schema)


class _Best:
    """The k best (score, id, copy) of a query so far, ties to the smaller id."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores, self.ids, self.copies = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, scores, ids, copies):
        s, i, c = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.copies, copies)))
        at = np.lexsort((c, i, -s))[:self.k]
        self.scores, self.ids, self.copies = s[at], i[at], c[at]

    @property
    def bound(self) -> float:
        return max(self.floor, self.scores[-1]) if len(self.scores) == self.k else self.floor


def _slack(norm: float) -> float:
    return 0.5 + 1e-7 * norm


def _search(pages: pd.DataFrame, q_ids, q_copies, q: np.ndarray, floors, dim: int, top: float, k: int) -> list[_Best]:
    """Best-first search of one subtree for each of a block of queries."""
    routers = np.stack([np.frombuffer(r) for r in pages["router"]])
    radius, to_parent = pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
    vectors = np.concatenate([np.frombuffer(v, "<i4").reshape(-1, dim) for v in pages["vectors"]]).astype(float)
    ids, copies, entry = (np.concatenate([np.asarray(x) for x in c])
                          for c in (pages["ids"], pages["copies"], [np.frombuffer(d) for d in pages["entry_dist"]]))
    ends = np.cumsum([len(i) for i in pages["ids"]])
    starts = np.concatenate([[0], ends[:-1]])
    lifted, out = np.column_stack([q, np.zeros(len(q))]), []
    to_root = _distances(lifted, np.frombuffer(pages["parent"].iloc[0])[None, :])[:, 0]
    reach = float(pages["parent_radius"].iloc[0])
    for n in range(len(q)):
        norm, best = float(q[n] @ q[n]) + top, _Best(k, floors[n])
        out.append(best)

        def open_(least):      # whether a row that far away can still be among the k best
            return (norm - np.maximum(least, 0.0) ** 2) / 2 >= best.bound - _slack(norm)

        if not open_(to_root[n] - reach):
            continue
        at = np.flatnonzero(open_(np.abs(to_root[n] - to_parent) - radius))      # before any page distance is computed
        far = np.sqrt(np.maximum(((routers[at] - lifted[n]) ** 2).sum(1), 0.0))
        order = np.argsort(far - radius[at], kind="stable")
        at, far, done, step = at[order], far[order], 0, 2
        while done < len(at):
            now = slice(done, done + step)
            ok = open_(far[now] - radius[at[now]])
            done, step = done + step, step * 4
            if not ok.any():      # best first: the rest is no nearer
                break
            page, d = at[now][ok], far[now][ok]
            rows = np.concatenate([np.arange(starts[p], ends[p]) for p in page])
            rows = rows[open_(np.abs(np.repeat(d, ends[page] - starts[page]) - entry[rows]))]
            scores = (vectors[rows] @ q[n]).astype(np.int64)
            good = (scores >= best.bound) & ~((ids[rows] == q_ids[n]) & (copies[rows] == q_copies[n]))
            best.add(scores[good], ids[rows][good], copies[rows][good])
    return out


def top_k(vectors: DataFrame, queries: DataFrame | None = None, every: int = 50, k: int = 5,
          id_col="vec_id", vec_col="embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller vec_id.

    ``queries``: (vec_id, copy) of the rows that query; by default those whose id is divisible by ``every``.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "topk")
    rows = stash.put(quantised(vectors, id_col, vec_col, scale), "rows")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                     F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("top")).first()
    total, dim, top = sizes["n"], sizes["dim"] or 1, float(sizes["top"] or 0)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_routers = min(MAX_ROUTERS, max(k + 1, -(-total // REGION_ROWS)))
    picked = rows.orderBy(F.xxhash64("vec_id", "copy"), "vec_id", "copy").limit(n_routers).collect()   # bounded
    routers = _matrix([r["v"] for r in picked], dim)
    marks = [(r["vec_id"], r["copy"]) for r in picked]
    placed = stash.put(place(rows, dim, top, routers), "placed")
    regions = {r["region"]: r for r in placed.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}   # <= MAX_ROUTERS rows

    def per_region(values: dict):
        return F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in values.items() for x in kv]), F.col("region"))

    parts = per_region({r: -(-v["n"] // SUBTREE_ROWS) for r, v in regions.items()})
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "copy"), parts))
    pages = stash.put(index(placed, dim, top), "pages")

    q = placed.filter(F.pmod("vec_id", F.lit(every)) == 0) if queries is None else placed.join(queries, ["vec_id", "copy"], "left_semi")
    names = sorted(regions)
    shared = spark.sparkContext.broadcast((routers, marks, np.array(names), _lift(routers, top)[names], np.array([regions[r]["far"] for r in names])))

    def at_home(pages_, asked):
        """The queries that lie in this subtree: their k best here and the bound that these and the routers give."""
        cols = ["query_id", "query_copy", "v", "home", "home_part", "bound", "scores", "ids", "copies"]
        if not len(pages_) or not len(asked):
            return pd.DataFrame([], columns=cols)
        x, ids, copies = _matrix(asked["v"], dim), asked["vec_id"].to_numpy(), asked["copy"].to_numpy()
        first = x @ shared.value[0].T
        for j, (i, c) in enumerate(shared.value[1]):
            first[(ids == i) & (copies == c), j] = -np.inf
        floors = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(x), -np.inf)
        best = _search(pages_, ids, copies, x, floors, dim, top, k)
        return pd.DataFrame({"query_id": ids, "query_copy": copies, "v": asked["v"].to_numpy(), "home": asked["region"].to_numpy(),
                             "home_part": asked["part"].to_numpy(), "bound": [b.bound for b in best], "scores": [b.scores for b in best],
                             "ids": [b.ids for b in best], "copies": [b.copies for b in best]})[cols]

    first = stash.put(
        pages.groupBy("region", "part").cogroup(q.select("vec_id", "copy", "v", "region", "part").groupBy("region", "part")).applyInPandas(
            at_home, "query_id long, query_copy long, v array<long>, home long, home_part long, bound double, "
                     "scores array<long>, ids array<long>, copies array<long>"), "first")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, name, centre, radius = shared.value
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), dim)
            norm = (x * x).sum(1) + top
            least = np.maximum(_distances(np.column_stack([x, np.zeros(len(x))]), centre) - radius, 0.0)
            room = (norm[:, None] - least * least) / 2 >= (b.column("bound").to_numpy() - _slack(norm))[:, None]
            who, where = np.nonzero(room)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(who)).columns, pa.array(name[where])], [*b.schema.names, "region"])

    asked = first.select("query_id", "query_copy", "v", "home", "home_part", "bound")
    asked = stash.put(asked.mapInArrow(route, "query_id long, query_copy long, v array<long>, home long, home_part long, bound double, region long"), "asked")
    found = first.select("query_id", "query_copy", F.inline(F.arrays_zip("scores", "ids", "copies")).alias("score", "vec_id", "copy"))
    open_ = {r["region"]: -(-r["n"] // BLOCK_QUERIES) for r in asked.groupBy("region").agg(F.count("*").alias("n")).collect()}   # <= MAX_ROUTERS rows
    if open_:
        blocks = per_region(open_)
        number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        asked = (asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query_copy"), blocks)).withColumn("part", number(parts))
                      .filter((F.col("region") != F.col("home")) | (F.col("part") != F.col("home_part"))).drop("home", "home_part"))
        there = pages.filter(F.col("region").isin(list(open_))).withColumn("block", number(blocks))

        def elsewhere(pages_, asked_):
            cols = ["query_id", "query_copy", "score", "vec_id", "copy"]
            if not len(pages_) or not len(asked_):
                return pd.DataFrame([], columns=cols).astype("int64")
            ids, copies = asked_["query_id"].to_numpy(), asked_["query_copy"].to_numpy()
            best = _search(pages_, ids, copies, _matrix(asked_["v"], dim), asked_["bound"].to_numpy(), dim, top, k)
            n = [len(b.scores) for b in best]
            return pd.DataFrame({"query_id": np.repeat(ids, n), "query_copy": np.repeat(copies, n), "score": np.concatenate([b.scores for b in best]),
                                 "vec_id": np.concatenate([b.ids for b in best]), "copy": np.concatenate([b.copies for b in best])})[cols]

        key = ["region", "part", "block"]
        found = found.unionByName(there.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
            elsewhere, "query_id long, query_copy long, score long, vec_id long, copy long"))
    best = W.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
