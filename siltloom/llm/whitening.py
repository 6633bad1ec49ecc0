"""Whitening of embeddings: exact distributed covariance, Householder tridiagonal form, Sturm counts, inverse iteration, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.llm.common import saved

#: Whole numbers are held within this bound before the offset is added.
MOST = 1 << 40
LIMB = 20
#: Most dimensions: the covariance (dim * dim numbers) goes to the driver.
MOST_DIM = 4096
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``components`` at most; an entry c becomes floor(scale * c) + offset; eigenvalues up to ``rank`` times the largest are noise of rounding and give no component."""

    components: int = 32
    scale: int = 64
    offset: int = 1_000_000
    rank: float = 1e-12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and Householder vectors (unit, of decreasing support) of a symmetric matrix."""
    a = a.copy()
    n = len(a)
    kept: list[np.ndarray] = []
    for j in range(n - 2):
        v = a[j + 1 :, j].copy()
        scale = np.abs(v[1:]).max(initial=0.0)
        if scale == 0.0:
            kept.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        kept.append(v)
        # a := h a h on the rest, h = 1 - 2 v v'
        rest = a[j + 1 :, j + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1 :, j] -= 2 * v * (v @ a[j + 1 :, j])
        a[j, j + 1 :] = a[j + 1 :, j]
    return np.diag(a).copy(), np.diag(a, -1).copy(), kept


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: sign changes of the Sturm sequence."""
    tiny = np.finfo(float).tiny
    least = np.maximum(np.finfo(float).eps * (np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0)), tiny) * 1e-3
    count = np.zeros(len(at), np.int64)
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < least, -least, q)  # as if ``at`` lay a little higher
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection to the last bit; all are bisected together."""
    r = np.abs(np.r_[0, e]) + np.abs(np.r_[e, 0])
    below = np.arange(len(d) - 1, len(d) - 1 - k, -1)  # eigenvalues below the wanted one
    low, high = np.full(k, (d - r).min()), np.full(k, (d + r).max())
    low, high = low - np.spacing(np.abs(low).max()) * 4, high + np.spacing(np.abs(high).max()) * 4
    for _ in range(200):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        less = sturm_counts(d, e, mid) <= below
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return low + (high - low) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(tridiagonal - shift) x = b by elimination with row exchanges."""
    n = len(d)
    a0, a1, a2, x = d - shift, np.r_[e, 0.0], np.zeros(n), b.copy()
    for i in range(n - 1):
        low = e[i]
        if abs(a0[i]) >= abs(low):
            pivot = a0[i] if abs(a0[i]) > least else np.copysign(least, a0[i])
            a0[i] = pivot
            f = low / pivot
            a0[i + 1] -= f * a1[i]
            x[i + 1] -= f * x[i]
        else:
            f = a0[i] / low
            up0, up1 = a0[i + 1], a1[i + 1]
            a0[i + 1], a1[i + 1] = a1[i] - f * up0, -f * up1
            a0[i], a1[i], a2[i] = low, up0, up1
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        pivot = a0[i] if abs(a0[i]) > least else np.copysign(least, a0[i])
        x[i] = (x[i] - (a1[i] * x[i + 1] if i + 1 < n else 0) - (a2[i] * x[i + 2] if i + 2 < n else 0)) / pivot
    return x


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of a cluster of near eigenvalues are made orthogonal to one another at each step."""
    n, norm = len(d), max(np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0), np.finfo(float).tiny)
    least, near = np.finfo(float).eps * norm, 1e-3 * norm
    out = np.zeros((n, len(values)))
    start, used = 0, np.inf
    draw = np.random.default_rng(12)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near:
            start = j
        shift = min(value, used - 2 * least) if j > start else value  # equal eigenvalues get shifts a little apart
        used = shift
        x = draw.standard_normal(n)
        for _ in range(6):
            x /= np.abs(x).max()
            x = _solve(d, e, shift, x / np.linalg.norm(x), least)
            if not np.isfinite(x).all():
                x = draw.standard_normal(n)
            for _ in range(2):  # once more against what rounding leaves
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
                x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors; the largest entry of each is positive."""
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    d, e, kept = tridiagonal(a / scale)
    values = leading_eigenvalues(d, e, k)
    v = eigenvectors(d, e, values)
    for j in range(len(kept) - 1, -1, -1):
        h = kept[j]
        v[j + 1 :] -= 2 * np.outer(h, h @ v[j + 1 :])
    v /= np.linalg.norm(v, axis=0)
    v *= np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    return values * scale, v


def whole_rows(vectors: DataFrame, how: Whitening) -> DataFrame:
    """(vec_id, x) of the vectors that count, in whole numbers without the offset; of several lengths the most frequent stays, of equally frequent the smaller."""
    number = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = vectors.select("vec_id", number.alias("x")).where((F.size("x") > 0) & ~bad)
    most = fine.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = most[0]["dim"] if most else 0
    if dim > MOST_DIM:
        raise ValueError(f"vectors of {dim} entries; the covariance of {MOST_DIM} at most fits the driver")
    bounded = F.transform("x", lambda c: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), c * how.scale))).cast("long"))
    return fine.where(F.size("x") == dim).select("vec_id", bounded.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            yield batch, x.reshape(batch.num_rows, -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _matrices(batches):
            n += len(x)
            part = x.sum(0).astype(object)
            total = part if total is None else total + part
        if n:
            yield _numbers([(-1, 0, n), *((i, 0, int(s)) for i, s in enumerate(total))])

    found = {r["i"]: int(r["s"]) for r in rows.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def _numbers(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, s = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.decimal128(38, 0))], ["i", "j", "s"])


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y in Python's whole numbers, for |y| up to 2**41: high and low parts are multiplied apart, in slices whose sums doubles hold exactly."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), 2048):
        part = y[at : at + 2048]
        high = (part >> LIMB).astype(np.float64)
        low = (part & ((1 << LIMB) - 1)).astype(np.float64)
        cross = high.T @ low
        total += ((high.T @ high).astype(np.int64).astype(object) << 2 * LIMB) + ((cross + cross.T).astype(np.int64).astype(object) << LIMB) + (low.T @ low).astype(np.int64).astype(object)
    return total


def squared_gaps(y: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * y - rest)**2 for each row, exact, at most the largest long: as n**2 yy - 2n ry + rr where the sums fit 64 bits."""
    most, dim = int(np.abs(y).max()) + 1, y.shape[1]
    if most * max(most, n) * dim < 1 << 62:
        own = (y * y).sum(1).astype(object) * (n * n) - (y @ rest.astype(np.int64)).astype(object) * (2 * n) + int((rest * rest).sum())
    else:
        own = ((n * y.astype(object) - rest) ** 2).sum(1)
    return [min(int(v), LONG) for v in own]


def centred_covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n. Tasks centre by the floor of the mean before they multiply, so that products are small and exact;
    the rest of the mean, below 1, is taken off in whole numbers: n * sum(y y') - r r', over n * n."""
    floor = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            part = exact_products(x - floor)
            total = part if total is None else total + part
        if total is not None:
            yield _numbers([(i, j, total[i, j]) for i in range(len(floor)) for j in range(i + 1)])

    out = np.zeros((len(floor), len(floor)))
    for r in rows.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (n * int(r["s"]) - rest[r["i"]] * rest[r["j"]]) / (n * n)
    return out


def _mean_and_covariance(rows: DataFrame, k: int, n: int) -> np.ndarray:
    """Covariance of double columns ``w``, centred by their means before multiplying."""

    def sums(batches: Iterator[pa.RecordBatch], mean: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k) if mean is not None else (1, k))
        for batch in batches:
            if batch.num_rows:
                w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += w.sum(0) if mean is None else (w - mean).T @ (w - mean)
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    def added(fn) -> np.ndarray:
        found = rows.select("w").mapInArrow(fn, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        out = np.zeros((k, k))
        for r in found:
            out[r["i"], r["j"]] = r["s"] / n
        return out

    mean = added(sums)[0]
    return added(lambda batches: sums(batches, mean))


def whiten(vectors: DataFrame, how: Whitening = Whitening()) -> DataFrame:
    """(vec_id, embedding) to one row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Sums and covariance are exact whole numbers, added up in tasks; only dim * dim totals reach the driver, which solves the eigenproblem. The projection
    (dim * components numbers) goes to the tasks. ``identity_error`` is measured on the rows returned, by two more passes over them.

    Vectors that are null, empty, or hold null or not finite entries are left out, as are those of another length than the most frequent one. Entries
    beyond 2**40 after scaling are held there, deviations beyond 64 bits at the largest long. Components of no variance can't be whitened: there are as many
    as the covariance has rank, so that equal vectors, one vector or an empty table give no rows. Repeated rows count and are returned each; a null vec_id
    stays null; further columns are left out.
    """
    spark = vectors.sparkSession
    rows = saved(whole_rows(vectors, how))
    n, sums = _sums(rows)
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("deviation long, w array<double>")])
    covariance = centred_covariance(rows, n, sums) if n else np.zeros((0, 0))
    values, components = leading_pairs(covariance, min(how.components, len(sums))) if n else (np.zeros(0), np.zeros((0, 0)))
    k = int((values > how.rank * max(values.max(initial=0), 0)).sum()) if n else 0
    if not k:
        empty = spark.createDataFrame([], schema)
        return _exploded(empty, n, np.zeros(0), 0.0)
    values, projection = values[:k], components[:, :k] / np.sqrt(values[:k])
    floor, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    below = np.array([float(r / n) for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches):
            y = x - floor
            w = (y - below) @ projection
            deviation = pa.array(squared_gaps(y, n, rest), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())], ["vec_id", "deviation", "w"])

    white = saved(rows.mapInArrow(run, schema))
    error = float(np.abs(_mean_and_covariance(white, k, n) - np.eye(k)).max())
    return _exploded(white, n, values / np.trace(covariance), error)


def _exploded(white: DataFrame, n: int, explained: np.ndarray, error: float) -> DataFrame:
    share = F.array(*[F.lit(float(v)) for v in explained]).cast("array<double>")
    rows = white.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_householder_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
