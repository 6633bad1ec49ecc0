"""What several operators share: tables in the shared folder, lookups, word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltloom.sources.batches import bounded_batches as _bounded_batches
from siltloom.sources.batches import byte_count, slices  # noqa: F401

#: A lookup table of at most this many (narrow) rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset in local mode (tests) a temporary one, on a cluster an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltloom-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siltloom-{spark.sparkContext.applicationId}"


def drop_saved(spark: SparkSession) -> None:
    """Delete all tables that ``saved`` wrote in this application; results that weren't written or read yet can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table with a saved table that has one (narrow) row for each key; null equals null.

    The lookup table is counted first: up to ``most`` rows it is broadcast. A larger one is joined by an equi-join of two exchanged
    inputs, the form in which adaptive execution splits the partitions of a hot key.
    """
    other = small.select([F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] + [c for c in small.columns if c not in keys])
    on = [big[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)]
    return big.join(F.broadcast(other) if small.count() <= most else other, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def map_rows(df: DataFrame, text: str, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Map slices of Arrow batches to columns; no shuffle. ``fn`` returns a list or array for each field of ``schema``."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(fields)
    _bounded_batches(df.sparkSession)

    def run(batches):
        for part in slices(batches, text):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
            del out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, fields)


def map_groups(df: DataFrame, keys: list[str], schema: str, fn: Callable[[pa.Table], dict], together: bool = False) -> DataFrame:
    """Map groups of rows with equal integer keys; groups of one row are left out. Callers bound the size of a group.

    Rows are dealt by the keys and sorted; a task holds one batch and one group at a time. ``together``: ``fn`` gets the groups that end in a batch in
    one call, not one by one.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    _bounded_batches(df.sparkSession)

    def run(batches):
        held: pa.Table | None = None
        out: list[dict] = []

        def made():
            parts = {f.name: [x for o in out for x in o[f.name]] for f in arrow}
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            columns = [held.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            starts = [0, *new.tolist()]
            if together:
                sizes = np.diff(starts)
                if (sizes > 1).any():
                    out.append(fn(held.slice(0, starts[-1]).filter(pa.array(np.repeat(sizes > 1, sizes)))))
            else:
                out += [fn(held.slice(a, b - a)) for a, b in zip(starts, starts[1:]) if b - a > 1]
            held = held.slice(starts[-1])
            if out:
                yield made()
        if held is not None and held.num_rows > 1:
            out.append(fn(held))
            yield made()
        del held
        pa.default_memory_pool().release_unused()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, fields)


class WordHashes(dict):
    """64-bit hash of each word met, kept for the next time; cleared at ``most`` words to bound memory."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """An ordered pair of 64-bit hashes as one."""
    x = a * _A + b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, from the words' hashes; by doubling, log n passes."""
    if len(h) < n:
        return h[:0]
    done, out, power, width, rest = 0, None, h, 1, n
    while rest:
        if rest & 1:
            part = power[done : done + len(h) - n + 1]
            out = part.copy() if out is None else mix(out, part)
            done += width
        rest >>= 1
        if rest:
            power = mix(power[:-width], power[width:])
            width *= 2
    return mix(out, np.uint64(n))


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (v, root), root the smallest id that v reaches.

    Rounds: each vertex hooks to its smallest neighbour where that is smaller, the trees are flattened by pointer jumping, and the edges are replaced by
    those between roots. What lies within a tree is gone after the round that found it, so that all edges are joined once, not once a round. At most half the
    vertices of a round have no smaller neighbour, and a path of n vertices takes O(log n) jumps. Tables are written to the shared folder; joins are plain
    equi-joins of written tables, which adaptive execution can split at hot vertices; nothing is collected.
    """
    directed = lambda df: saved(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    e = directed(edges)
    labels = None
    while True:
        up = e.select(F.col("b").alias("v"), F.col("a").alias("root")).union(e.select("a", "a"))
        trees = saved(up.groupBy("v").agg(F.min("root").alias("root")))
        while True:
            above = trees.select(F.col("v").alias("root"), F.col("root").alias("up"))
            jumped = saved(trees.select("v", "root").join(above, "root").select("v", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
            if jumped.where("moved").isEmpty():
                break
            trees = jumped.select("v", "root")
        if labels is None:
            labels = trees
        else:
            labels = saved(labels.join(trees.select(F.col("v").alias("root"), F.col("root").alias("up")), "root", "left").select("v", F.coalesce("up", "root").alias("root")))
        of = lambda c: trees.select(F.col("v").alias(c), F.col("root").alias(f"r{c}"))
        e = directed(e.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if e.isEmpty():
            return labels
