"""Exact k-means of integer vectors with ns-bounds (norm of the sum).

Each vector remembers, for every centroid, the last distance it computed and the round of it.
The centroids of all rounds are retained, so that a remembered distance is loosened by how far
the centroid is now from where it was then: the norm of its total displacement, which is never
more, and often much less, than the drifts of the rounds in between summed up. A centroid whose
loosened lower bound exceeds the upper bound to the vector's own centroid cannot be nearer; the
others are rescanned with exact integer distances, so assignments equal those of a full scan.

Vectors stay where they are: a round is one scan that writes cluster and bounds beside the
vector, and one aggregation of sums by cluster that is combined before the shuffle. Only the
centroids (``k`` times the dimension, for each round) reach the driver and travel to the tasks.

Kept are vectors of exactly ``dimension`` components, none of them null, infinite or NaN.
A vector with so large a component (see ``most``) that a distance might not fit a long is not
kept either. Ties go to the centroid with the smaller number. Repeated ids
and equal vectors are assigned each; a null id is hashed as an empty one, and equal hashes are
ordered by their vectors. With less than ``k`` vectors there are as many centroids; with none
there is no row. Other columns of the table, whatever their names, are not read. A sum of
distances that no long holds is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import keep

DIMENSION = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
LONG = 2**63 - 1

# Bounds are stored as floats; this covers their rounding and that of the displacements.
SLACK = 1e-6


def most(dimension: int) -> int:
    """The largest size of a component, as integer, with which every squared distance fits a long."""
    return math.isqrt(LONG // dimension) // 2


def prepared(
    vectors: DataFrame, key: str, vector: str, dimension: int = DIMENSION, scale: int = SCALE
) -> DataFrame:
    """(id, x) of the kept vectors, components as integers floor(scale * component)."""
    raw = F.col(f"`{vector}`")

    def usable(c: Column) -> Column:
        size = F.abs(c.cast("double") * scale)
        # NaN is the largest value to Spark, so this excludes it.
        return c.isNotNull() & (size <= F.lit(float(most(dimension))))

    kept = vectors.where(raw.isNotNull() & (F.size(raw) == dimension) & F.forall(raw, usable))
    whole = F.transform(raw, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    return kept.select(F.col(f"`{key}`").alias("id"), whole.alias("x"))


def first_centroids(points: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The ``k`` points with the smallest sha256 of ``seed:id``, in ascending order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select("x", mark.alias("mark")).orderBy("mark", "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0].x) if rows else 0)


def _distances(x: np.ndarray, centroids: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (rows, which)."""
    gap = x[rows] - centroids[which]
    return np.einsum("ij,ij->i", gap, gap)


def assign(
    x: np.ndarray,
    cluster: np.ndarray | None,
    known: np.ndarray | None,
    seen: np.ndarray | None,
    history: np.ndarray,
    exact: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, bounds, their rounds, own squared distances and how many distances were computed.

    ``known`` are the last computed distances and ``seen`` the rounds of ``history`` they refer to;
    without them all distances are computed. ``exact`` asks for every own distance, which is
    otherwise -1 where the bounds alone settled the vector.
    """
    now, k, n = len(history) - 1, history.shape[1], len(x)
    centroids = history[now]
    everyone = np.arange(n)
    if cluster is None:
        squares = np.stack([_distances(x, centroids, everyone, np.full(n, j)) for j in range(k)], axis=1)
        cluster = squares.argmin(axis=1)  # the first of equal ones
        known, seen = np.sqrt(squares), np.full((n, k), now)
        return cluster, known, seen, squares[everyone, cluster], np.full(n, k)
    moved = np.sqrt(((history - centroids) ** 2).sum(axis=2).astype(np.float64))  # by round and centroid
    shift = moved[seen, np.arange(k)]
    low = (known - shift) - SLACK * (known + shift)
    own = known[everyone, cluster] + shift[everyone, cluster]
    own *= 1 + SLACK
    low[everyone, cluster] = np.inf
    known, seen, cluster = known.copy(), seen.copy(), cluster.copy()
    squares = np.full(n, -1, dtype=np.int64)
    work = np.zeros(n, dtype=np.int64)

    # The own distance first: it alone settles many vectors.
    tight = everyone if exact else np.flatnonzero((low <= own[:, None]).any(axis=1))
    if not len(tight):
        return cluster, known, seen, squares, work
    squares[tight] = _distances(x, centroids, tight, cluster[tight])
    work[tight] += 1
    own[tight] = np.sqrt(squares[tight]) * (1 + SLACK)
    known[tight, cluster[tight]] = np.sqrt(squares[tight])
    seen[tight, cluster[tight]] = now

    rows, which = np.nonzero(low[tight] <= own[tight][:, None])
    rows = tight[rows]
    found = _distances(x, centroids, rows, which)
    np.add.at(work, rows, 1)
    known[rows, which], seen[rows, which] = np.sqrt(found), now
    # Of the rescanned and the own centroid the nearest, of equally near ones the first.
    rows, which = np.concatenate([rows, tight]), np.concatenate([which, cluster[tight]])
    found = np.concatenate([found, squares[tight]])
    order = np.lexsort((which, found, rows))
    rows, which, found = rows[order], which[order], found[order]
    first = np.append(True, rows[1:] != rows[:-1])
    cluster[rows[first]], squares[rows[first]] = which[first], found[first]
    return cluster, known, seen, squares, work


_FIELDS = "id {id}, x array<int>, cluster int, known array<float>, seen array<int>, distance bigint, computed bigint"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _round(state: DataFrame, history: list[np.ndarray], exact: bool) -> DataFrame:
    """``state`` with clusters and bounds for the last centroids of ``history``."""
    past, first = np.stack(history), len(history) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(1), n).astype(np.int64)
            cluster = known = seen = None
            before = np.zeros(n, dtype=np.int64)
            if not first:
                cluster = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                known = _matrix(batch.column(3), n).astype(np.float64)
                seen = _matrix(batch.column(4), n).astype(np.int64)
                before = batch.column(6).to_numpy(zero_copy_only=False)
            cluster, known, seen, squares, work = assign(x, cluster, known, seen, past, exact)
            width = known.shape[1]
            starts = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(cluster.astype(np.int32)),
                    pa.ListArray.from_arrays(starts, pa.array(known.astype(np.float32).ravel())),
                    pa.ListArray.from_arrays(starts, pa.array(seen.astype(np.int32).ravel())),
                    pa.array(squares),
                    pa.array(before + work),
                ],
                names=["id", "x", "cluster", "known", "seen", "distance", "computed"],
            )

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(run, _FIELDS.format(id=kind))


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; an empty cluster's centroid stays."""
    width = centroids.shape[1]
    sums = [F.sum(F.col("x")[i].cast("bigint")).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(width)]
    return out


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dimension: int = DIMENSION,
    scale: int = SCALE,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(key, x, cluster, distance, computed) of every kept vector, and the final centroids.

    ``distance`` is squared; ``computed`` is how many distances the bounds left to compute in all
    rounds together.
    """
    points = prepared(vectors, key, vector, dimension, scale)
    history = [first_centroids(points, k, seed)]
    if not len(history[0]):
        none = points.select(
            F.col("id").alias(key),
            "x",
            F.lit(0).alias("cluster"),
            F.lit(0).cast("bigint").alias("distance"),
            F.lit(0).cast("bigint").alias("computed"),
        )
        return none.limit(0), history[0]
    state = points
    for step in range(rounds + 1):
        state = keep(_round(state, history, step == rounds), "clustering")
        if step < rounds:
            history.append(_moved(state, history[-1]))
    return state.select(F.col("id").alias(key), "x", "cluster", "distance", "computed"), history[-1]


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256 (one row per centroid joined)."""
    fits = lambda n: n if n <= LONG else None
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    total = fits(sum(int(r.s) for r in sums))
    rows = [
        (r.cluster, fits(int(r.s)), total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest())
        for r in sums
    ]
    about = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(about), "cluster")
