"""Vectors: embedding by a user's function, checks, cosine and exact top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltloom.sources.batches import bounded_batches

EMBED_LIMIT, BATCH = 20000, 25
#: Bytes of query vectors that are broadcast; beyond that queries and chunks meet in blocks.
QUERY_BYTES = 64 << 20
#: Bytes of the chunk vectors that a task holds then, and the queries that it scores at once.
BLOCK_BYTES, QUERIES = 64 << 20, 256
#: Scores that a task holds at a time, and the queries that a row of blocks has at least where there are more.
SCORES, WIDE = 1 << 20, 1024


def fit_dim(vector: Column, dim: int) -> Column:
    """The first ``dim`` numbers."""
    return F.slice(vector, 1, dim)


def is_valid(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def validate_vectors(df: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with valid vectors, cut to ``dim`` first, and the rejects."""
    fitted = df.withColumn(column, fit_dim(F.col(column), dim))
    ok = is_valid(F.col(column), dim)
    return fitted.where(ok), df.where(~is_valid(fit_dim(F.col(column), dim), dim))


def hashed_embedding(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(df: DataFrame, fn: Callable[[list[str]], np.ndarray], dim: int, text: str = "embed_text", distinct: bool = True) -> DataFrame:
    """``df`` with ``embedding``: ``fn`` gets lists of 25 texts at most, cut to 20,000 characters, and returns one vector a text.

    With ``distinct`` equal texts are embedded once (a shuffle of hashes and texts that the model's cost repays). A null text is embedded as empty.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            cut = [(t or "")[:EMBED_LIMIT] for t in texts]
            parts = [np.asarray(fn(cut[i : i + BATCH]), np.float32)[:, :dim] for i in range(0, len(cut), BATCH)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    bounded_batches(df.sparkSession)
    if not distinct:
        return df.withColumn("embedding", run(text))
    t = F.coalesce(F.col(text), F.lit(""))
    vectors = df.select(F.sha2(t, 256).alias("__h"), t.alias("__t")).groupBy("__h").agg(F.first("__t").alias("__t")).select("__h", run("__t").alias("embedding"))
    return df.withColumn("__h", F.sha2(t, 256)).join(vectors, "__h").drop("__h")


def cosine(a: Column, b: Column) -> Column:
    """In double precision, for small inputs; 0 if a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


class Best:
    """The k best (score, then chunk id) for each query of a block, kept as columns and cut back when they grow."""

    def __init__(self, queries: pa.Table | pa.RecordBatch, k: int):
        v = queries.column("vector")
        self.dim, self.k = pc.max(pc.list_value_length(v)).as_py(), k
        ok, x = _same_length(v, self.dim)
        self.fits, self.m = np.zeros(len(v), bool), np.zeros((len(v), self.dim))
        self.fits[ok], self.m[ok] = True, x
        self.ids, self.scopes = queries.column("query_id"), list(zip(queries.column("repo").to_pylist(), queries.column("branch").to_pylist()))
        of: dict[tuple[str | None, str | None], list[int]] = {}
        for i in np.flatnonzero(self.fits).tolist():
            of.setdefault(self.scopes[i], []).append(i)
        self.rows = {scope: np.array(rows) for scope, rows in of.items()}
        self.least = np.full(len(v), -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, x: np.ndarray, ids: pa.Array, repo: pa.Array, branch: pa.Array) -> None:
        """Chunks of unit vectors. Queries of a scope meet the chunks of that scope, at most SCORES scores at a time. A query's candidates of a block are
        those not below its k-th best there; ties all stay for now."""
        for (r, b), rows in self.rows.items():
            inside = np.ones(len(x), bool)
            for want, own in ((r, repo), (b, branch)):
                if want is not None:
                    inside &= pc.fill_null(pc.equal(own, want), False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            wide = max(1, min(len(at), SCORES // max(1, min(len(rows), WIDE))))
            for j0 in range(0, len(at), wide):
                some = at[j0 : j0 + wide]
                y = x[some].T
                for i0 in range(0, len(rows), max(1, SCORES // wide)):
                    self._meet(rows[i0 : i0 + max(1, SCORES // wide)], y, some, ids)

    def _meet(self, rows: np.ndarray, y: np.ndarray, some: np.ndarray, ids: pa.Array) -> None:
        s = np.round(self.m[rows] @ y, 12)  # the order of additions, which hangs on the block's shape, must not part equal scores
        k = min(self.k, s.shape[1])
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        q, j = np.nonzero(s >= np.maximum(least, self.least[rows])[:, None])
        self.kept.append((rows[q], s[q, j], ids.take(pa.array(some[j]))))
        if k == self.k:
            self.least[rows] = np.maximum(self.least[rows], least)  # the query's k-th best is no less
        self.size += len(q)
        if self.size > 2 * self.k * len(self.scopes) + 100_000:
            self.cut()

    def cut(self) -> pa.RecordBatch:
        q, s = np.concatenate([a for a, *_ in self.kept]), np.concatenate([b for _, b, _ in self.kept])
        ids = pa.concat_arrays([c for *_, c in self.kept])
        rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -s, q))
        first = np.searchsorted(q[order], q[order])  # where the query's rows begin
        order = order[np.arange(len(order)) - first < self.k]
        self.kept, self.size = [(q[order], s[order], ids.take(pa.array(order)))], len(order)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(q[order])), self.kept[0][2], pa.array(s[order])], ["query_id", "chunk_id", "score"])


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 0, x / np.where(norm == 0, 1, norm), 0)


def _same_length(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of those with ``dim`` numbers."""
    ok = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    return ok, unit(pc.list_flatten(column.take(pa.array(ok))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, vector: str = "embedding", query_bytes: int = QUERY_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best chunks by cosine for each query: (query_id, chunk_id, score, rank), exact, ties by chunk_id.

    queries: (query_id, vector, repo?, branch?), filters null for any; chunks: (chunk_id, repo, branch, embedding). The queries are counted first. Up to ``query_bytes``
    of them are broadcast: chunk vectors then stay where they are. More never pass through the driver: chunks are dealt once by hash to groups of ``block_bytes``, queries go to each group,
    and a task holds one group's matrix while blocks of queries stream past it. Both ways scan the chunks once, whatever the number of queries; each block of chunks gives k rows a query, which are
    ranked at last. Scores are rounded to 12 digits. A chunk whose vector is null or of another length, and a query whose vector is null, give no rows.
    """
    named = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *[(F.col(c) if c in queries.columns else F.lit(None)).cast("string").alias(c) for c in ("repo", "branch")]).where("vector is not null")
    own = chunks.select("chunk_id", F.col("repo").cast("string").alias("repo"), F.col("branch").cast("string").alias("branch"), F.col(vector).cast("array<double>").alias("v"))
    bounded_batches(queries.sparkSession)
    n, dim = named.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    found = _in_place(named, own, k) if n * max(1, dim) * 8 <= query_bytes else _in_blocks(named, own, k, max(1, dim), block_bytes)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.where(F.col("rank") <= k)


def _schema(queries: DataFrame, chunks: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"


def _in_place(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    held = queries.sparkSession.sparkContext.broadcast(queries.orderBy("query_id").toArrow())  # counted before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value.combine_chunks()
        lengths = sorted(set(pc.unique(pc.list_value_length(asked.column("vector"))).to_pylist()) - {0})
        best = [(d, Best(asked.filter(pc.equal(pc.list_value_length(asked.column("vector")), d)).combine_chunks().to_batches()[0], k)) for d in lengths]
        for batch in batches:
            for d, b in best:
                ok, x = _same_length(batch.column("v"), d)
                if len(ok):
                    at = pa.array(ok)
                    b.add(x, batch.column("chunk_id").take(at), batch.column("repo").take(at), batch.column("branch").take(at))
        for _, b in best:
            if b.kept:
                yield b.cut()

    return chunks.mapInArrow(run, _schema(queries, chunks))


def _in_blocks(queries: DataFrame, chunks: DataFrame, k: int, dim: int, block_bytes: int) -> DataFrame:
    """Rows of a group come sorted, its chunks before the queries."""
    groups = max(1, -(-chunks.count() * dim * 8 // block_bytes))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = chunks.select(F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "chunk_id", none(queries, "query_id"), "repo", "branch", F.col("v").alias("vector"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), none(chunks, "chunk_id"), "query_id", "repo", "branch", "vector")
    together = left.unionByName(right).repartition(groups, "g").sortWithinPartitions("g", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, matrices = None, [], {}
        for batch in batches:
            g, kind = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if g[a] != group:
                    group, held, matrices = g[a], [], {}
                if kind[a] == 0:
                    held.append(part)
                    continue
                table = pa.Table.from_batches(held).combine_chunks() if held else None
                held = [table.to_batches()[0]] if table is not None and table.num_rows else []
                for at in range(0, part.num_rows if held else 0, QUERIES):
                    some = part.slice(at, QUERIES)
                    lengths = pc.list_value_length(some.column("vector"))
                    for d in sorted(set(lengths.to_pylist()) - {0}):
                        if d not in matrices:
                            matrices[d] = _same_length(held[0].column("vector"), d)
                        ok, x = matrices[d]
                        if len(ok):
                            best, of = Best(some.filter(pc.equal(lengths, d)), k), pa.array(ok)
                            best.add(x, held[0].column("chunk_id").take(of), held[0].column("repo").take(of), held[0].column("branch").take(of))
                            if best.kept:
                                yield best.cut()

    return together.mapInArrow(run, _schema(queries, chunks))
