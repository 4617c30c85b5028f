import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pitlog.llm import clustering as M


def brute(rows, k, rounds, seed="1", dimension=64, scale=64):
    """Every distance of every round, in Python integers."""
    kept = [(i, [int(np.floor(float(c) * scale)) for c in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(c is not None and np.isfinite(c) for c in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for step in range(rounds + 1):
        nearest = [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if step == rounds:
            break
        for j in range(len(centroids)):
            own = [x for (_, x), n in zip(kept, nearest) if n[1] == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((str(i), j, d) for (i, _), (d, j) in zip(kept, nearest)), centroids


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash"))


def vectors(seed, n, spread=0.3):
    r = random.Random(seed)
    tops = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    out = []
    for i in range(n):
        top = tops[r.randrange(9)]
        out.append((i, [float(np.float32(c + r.gauss(0, spread))) for c in top]))
    return out


def found(spark, rows, **kw):
    assigned, centroids = M.cluster(table(spark, rows), **kw)
    got = assigned.collect()
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in got), centroids, got


def test_bounds_give_the_clusters_of_a_full_scan(spark):
    for seed, spread in ((1, 0.1), (2, 1.0)):
        rows = vectors(seed, 400, spread)
        want, centroids = brute(rows, 16, 5)
        got, last, full = found(spark, rows, rounds=5)
        assert got == want
        assert last.tolist() == centroids
        # Some distances were never computed: that is what the bounds are for.
        assert sum(r.computed for r in full) < 0.8 * 400 * 16 * 6


def test_rounds_in_numpy_equal_full_scans():
    r = np.random.default_rng(3)
    x = r.integers(-40, 40, (500, 8))
    history = [x[:6].copy()]
    state = (None, None, None)
    for step in range(8):
        cluster, known, seen, squares, _ = M.assign(x, *state, np.stack(history), step == 7)
        full = ((x[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all()
        assert ((squares == -1) | (squares == full.min(axis=1))).all()
        # What is stored are floats, as in the table.
        state = (cluster, known.astype(np.float32).astype(np.float64), seen)
        moved = history[-1].copy()
        for j in range(6):
            if (cluster == j).any():
                moved[j] = x[cluster == j].sum(axis=0) // (cluster == j).sum()
        history.append(moved)


def test_odd_vectors(spark):
    rows = vectors(5, 30)
    bad = [(100, None), (101, [1.0] * 63), (102, [float("nan")] + [0.0] * 63), (103, [float("inf")] + [0.0] * 63),
           (104, [None] + [0.0] * 63), (105, []), (106, [1.0] * 65), (107, [3e38] + [0.0] * 63)]
    # Equal vectors, a repeated id and ids that are missing are assigned each.
    odd = [(7, rows[7][1]), (200, rows[3][1]), (None, rows[4][1]), (None, [0.5] * 64)]
    want, centroids = brute(rows + odd, 16, 3)
    got, last, _ = found(spark, rows + bad + odd)
    assert got == want and last.tolist() == centroids


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    want, _ = brute(rows, 16, 3)
    assert found(spark, rows)[0] == want


def test_few_vectors_and_none(spark):
    rows = vectors(6, 5)
    assert found(spark, rows)[0] == brute(rows, 16, 3)[0]
    assigned, centroids = M.cluster(table(spark, [(1, None)]))
    assert len(centroids) == 0 and M.with_inertia(assigned, centroids).count() == 0


def test_inertia_and_centroid_hash(spark):
    rows = vectors(8, 60)
    want, centroids = brute(rows, 16, 3)
    assigned, last = M.cluster(table(spark, rows))
    by = {}
    for _, j, d in want:
        by[j] = by.get(j, 0) + d
    for r in M.with_inertia(assigned, last).collect():
        assert (r.cluster_inertia, r.inertia) == (by[r.cluster], sum(by.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
