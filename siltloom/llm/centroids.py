"""Centroid clustering by a threshold algorithm: sorted lists of centroids for each dimension are walked outward from a vector's values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.llm.common import saved

#: Integer components are held within this bound, so that squared distances of up to 64 dimensions fit 64 bits.
MOST = 1 << 27
LONG = (1 << 63) - 1
#: Most centroids times dimensions; the centroids go to the driver and to all tasks.
MOST_NUMBERS = 1 << 22
#: Vectors that walk together.
TOGETHER = 2048


@dataclass(frozen=True)
class Clusters:
    """``k`` centroids of ``dim`` components, ``rounds`` of assignment and replacement, components scaled by ``scale``; ``seed`` leads the texts that are hashed to choose the first centroids."""

    k: int = 40
    dim: int = 64
    rounds: int = 5
    scale: int = 256
    seed: str = "2:"

    def __post_init__(self):
        if self.k * self.dim > MOST_NUMBERS or self.dim > 64:
            raise ValueError(f"k * dim may be {MOST_NUMBERS} at most, dim 64")


class Lists:
    """For each dimension the centroids' values in order, and which centroid each belongs to."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()  # dimension x rank
        self.values = np.take_along_axis(centroids.T, self.order, 1).copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of x, ties to the smaller number, and its squared distance."""
        found = [self._walk(x[i : i + TOGETHER]) for i in range(0, len(x), TOGETHER)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Threshold algorithm. In each round every dimension's list gives its next centroid outward from the vector's value (sorted access); a centroid
        seen first gets its exact distance (random access). What isn't seen yet is in each dimension at least as far as the frontier, so that a vector
        stops once the sum of its frontiers' squares strictly exceeds its best distance: at equality a smaller number could still tie.
        """
        n, (dims, k) = len(x), self.values.shape
        right = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], 1)
        left = right - 1
        best, of = np.full(n, LONG), np.full(n, k)
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)
        at = np.arange(dims)[None, :]
        while len(rows):
            v = x[rows]
            low = np.where(left >= 0, v - self.values[at, np.maximum(left, 0)], LONG)
            high = np.where(right < k, self.values[at, np.minimum(right, k - 1)] - v, LONG)
            down = low <= high
            frontier = np.minimum(low, high)
            met = self.order[at, np.where(down, np.maximum(left, 0), np.minimum(right, k - 1))]
            fresh = np.zeros((len(rows), k), bool)
            fresh[np.arange(len(rows))[:, None], met] = True
            fresh &= ~seen[rows]
            seen[rows] |= fresh
            i, c = np.nonzero(fresh)
            gap = v[i] - self.centroids[c]
            exact = np.einsum("ij,ij->i", gap, gap)
            # of the fresh ones of a row the nearest, then the smallest number, stands first
            order = np.lexsort((c, exact, i))
            first = order[np.r_[True, np.diff(i[order]) > 0]] if len(order) else order
            r, d, c = rows[i[first]], exact[first], c[first]
            better = (d < best[r]) | ((d == best[r]) & (c < of[r]))
            best[r[better]], of[r[better]] = d[better], c[better]
            left, right = left - down, right + ~down
            on = (np.einsum("ij,ij->i", frontier, frontier) <= best[rows]) & ~seen[rows].all(1)
            rows, left, right = rows[on], left[on], right[on]
        return of, best


def whole_vectors(vectors: DataFrame, how: Clusters) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with ``dim`` components, none null or not finite. Values beyond 2**27 are held there."""
    number = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform("x", lambda c: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), c * how.scale))).cast("int"))
    return vectors.select("vec_id", number.alias("x")).where((F.size("x") == how.dim) & ~bad).select("vec_id", scaled.alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _sums(rows: DataFrame, lists: Lists, how: Clusters) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of each centroid's vectors. A task returns a row for each centroid at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(how.k, np.int64), np.zeros((how.k, how.dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, how.dim)
                of, _ = lists.nearest(x)
                n += np.bincount(of, minlength=how.k)
                np.add.at(sums, of, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("x").mapInArrow(run, "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(how.dim)])
    return {r["cluster"]: (r["n"], [int(v) for v in r[2:]]) for r in total.collect()}  # k rows at most


def cluster_vectors(vectors: DataFrame, how: Clusters = Clusters()) -> DataFrame:
    """(vec_id, embedding) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), exact in whole numbers.

    The first centroids are the ``k`` vectors with the smallest hash of seed and id (fewer if there are fewer vectors). Each round assigns all vectors and
    replaces centroids by the floor of their vectors' mean; one that lost all its vectors stays. Vectors are written once in whole numbers and read by each
    round in place: tasks get the centroids (k * dim numbers, bounded) and send back sums for each centroid, never vectors.

    Vectors that are null, of another length, or hold null or not finite components are left out. A null vec_id is hashed last and assigned like others;
    repeated rows count and are returned each; equal hashes go by their components. Inertias beyond 64 bits are held at the largest long. Further columns
    are left out; an empty table gives an empty result.
    """
    rows = saved(whole_vectors(vectors, how))
    hashed = F.sha2(F.concat(F.lit(how.seed), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(F.asc_nulls_last(hashed), "x").limit(how.k).select("x").collect()
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance long")])
    if not first:
        return _told(vectors.sparkSession.createDataFrame([], schema), [], how)
    centroids = np.array([r["x"] for r in first], np.int64)
    how = Clusters(len(centroids), how.dim, how.rounds, how.scale, how.seed)
    for _ in range(how.rounds):
        for c, (n, sums) in _sums(rows, Lists(centroids), how).items():
            centroids[c] = [s // n for s in sums]
    lists = Lists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of, distance = lists.nearest(_matrix(batch, how.dim))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(of, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return _told(saved(rows.mapInArrow(run, schema)), centroids.tolist(), how)


def _told(assigned: DataFrame, centroids: list[list[int]], how: Clusters) -> DataFrame:
    """Adds what is known of each cluster: a lookup of k rows at most."""
    held = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, min(s, LONG), min(sum(held.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in held.items()]
    of = assigned.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_threshold_algorithm(spark, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
