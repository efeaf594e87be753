"""Votes of all KNN candidates over gathered neighbour lists, against a plain count."""
import numpy as np

from sparkclf.models import search as SM


def test_votes_of_all_candidates_as_counted_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        n = int(rng.integers(0, 8))
        dist = np.sort(np.round(rng.random(n) * (rng.random() < 0.8), 1)).tolist()
        rows.append((i % 3, ["euclidean", "manhattan"][i % 2], int(rng.integers(3)), sorted(rng.integers(1, 6, n).tolist()), dist, rng.integers(0, 3, n).tolist()))
    lists = spark.createDataFrame(rows, "fold int, metric string, y int, rank array<int>, dist array<double>, ci array<int>").repartition(4)
    cands = [{"n_neighbors": n, "weights": w, "metric": m} for n in (1, 3, 5) for w in ("uniform", "distance") for m in ("euclidean", "manhattan")]
    want = {}
    for fold, metric, y, rank, dist, ci in rows:
        for i, c in enumerate(cands):
            near = [(d, x) for r, d, x in zip(rank, dist, ci) if r <= c["n_neighbors"]]
            if metric != c["metric"] or not near:
                continue
            zero, votes = any(d == 0 for d, _ in near), [0.0] * 3
            for d, x in near:
                votes[x] += 1.0 if c["weights"] == "uniform" else float(d == 0) if zero else 1 / d
            key = (fold, i, y, votes.index(max(votes)))
            want[key] = want.get(key, 0) + 1
    got = {(r["job"], r["cut"], r["y"], r["pred"]): r["c"] for r in SM._knn_confusions(lists, cands, 3).collect()}
    assert got == want
