"""Centroid clustering of integer vectors by Lloyd rounds with partial-distance search.

Components become integers, so that distances, sums and ties are exact. A task takes its vectors in batches; the squared
differences are added up over the dimensions of high variance first, and a centroid is abandoned for a vector as soon as
its partial distance is strictly above the best full distance that the vector has; those left finish all dimensions.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Integers beyond this could overflow a distance of 64 bits.
LARGEST = (1 << 27) - 1
#: Dimensions that are added up between two looks at the best distance.
STEP = 8


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance; dimensions stand in order of search."""
    rows, dims = np.arange(len(x)), x.shape[1]
    head = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(min(step, dims)):
        head += (x[:, d, None] - centroids[None, :, d]) ** 2
    who = head.argmin(1)  # the most promising one sets the first bound
    best = ((x - centroids[who]) ** 2).sum(1)
    for k, c in enumerate(centroids):
        left = rows[head[:, k] <= best]
        sums = head[left, k]
        for at in range(step, dims, step):
            sums = sums + ((x[left, at : at + step] - c[at : at + step]) ** 2).sum(1)
            near = sums <= best[left]
            left, sums = left[near], sums[near]
        better = (sums < best[left]) | (k < who[left])
        best[left[better]], who[left[better]] = sums[better], k
    return who, best


def _batches(batches, dims: int):
    """Arrow batches with their vectors as one array."""
    for b in batches:
        if b.num_rows:
            yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims).astype(np.int64)


def _means(vectors: DataFrame, centroids: list[list[int]], order: list[int], dims: int) -> list[list[int]]:
    """The centroids after one round: a task sends the sums of each centroid that its vectors have."""
    start = np.array(centroids, np.int64)

    def sums(batches):
        import pyarrow as pa

        n, total = np.zeros(len(start), np.int64), np.zeros((len(start), dims), np.int64)
        for _, x in _batches(batches, dims):
            who, _ = nearest(x[:, order], start[:, order])
            n += np.bincount(who, minlength=len(start))
            np.add.at(total, who, x)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(at, dims).astype(np.int32), "dim": np.tile(np.arange(dims, dtype=np.int32), len(at)), "total": total[at].ravel(), "n": np.repeat(n[at], dims)})

    part = vectors.mapInArrow(sums, "cluster int, dim int, total long, n long")
    out = [list(c) for c in centroids]
    for r in part.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * dims rows
        out[r.cluster][r.dim] = r.total // r.n
    return out


def _by_variance(vectors: DataFrame, dims: int) -> list[int]:
    """The dimensions, those of high variance first."""

    def moments(batches):
        import pyarrow as pa

        m = np.zeros((3, dims))
        for _, x in _batches(batches, dims):
            m += [np.full(dims, len(x)), x.sum(0), (x * x).sum(0, dtype=np.float64)]
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "n": m[0], "s": m[1], "q": m[2]})

    sums = vectors.mapInArrow(moments, "dim int, n double, s double, q double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in "nsq")).collect()
    variance = {r.dim: r.q / r.n - (r.s / r.n) ** 2 if r.n else 0.0 for r in sums}
    return sorted(range(dims), key=lambda d: -variance.get(d, 0.0))


def kept_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, x) of the vectors with exactly so many components, none null or non-finite; x are floor(scale * component).

    A component beyond 2**27 in size (after scaling) is an error, as its distances would not fit.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    whole = F.transform(e, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall("x", lambda c: F.abs(c) <= LARGEST)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter((F.size(e) == dims) & finite).select("vec_id", whole.alias("x"))
    return kept.select("vec_id", F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is beyond 2**27"))).alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of seed:vec_id (a null id is empty; equal ids go by their components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.x) for r in kept.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of each vector of (vec_id, embedding) that is kept.

    Vectors of another length, with a null or with a component that is not finite are left out, other columns are not
    read; repeated rows and repeated or null ids stay rows of their own. Fewer vectors than k give as many centroids; an
    empty table gives no rows. A centroid that no vector is nearest to stays as it is. The driver holds k centroids of
    dims integers; a round shuffles a sum for each task, centroid and dimension, so hot clusters cost nothing more.
    """
    kept = materialize(kept_vectors(vectors, dims, scale))
    centroids = first_centroids(kept, k, seed)
    order = _by_variance(kept, dims)
    for _ in range(rounds if centroids else 0):
        centroids = _means(kept, centroids, order, dims)
    last = np.array(centroids, np.int64).reshape(-1, dims)

    def assign(batches):
        import pyarrow as pa

        for b, x in _batches(batches, dims):
            who, best = nearest(x[:, order], last[:, order])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(who, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = materialize(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    parts = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = [(i, parts.get(i, 0), sum(parts.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centroids)]
    facts = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<int>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")  # at most k rows
