"""Near-duplicate vectors by a pivot-permutation index: ordered nearest pivots, inverted pivot lists, shared-pivot counts, verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.llm.common import components, lookup, map_groups, map_rows, saved


#: Parts of the hash range by which vectors are sampled.
SHARES = 1 << 40


@dataclass(frozen=True)
class Index:
    """``nearest``: pivots that describe a vector; ``shared``: pivots that a candidate pair must have in common (2 at least);
    ``most_pivots``: bound of the pivots of one dimension (chosen from about 4 x as many sampled vectors), a quarter of that of all; ``block``: rows compared with each other at once.
    """

    cosine: float = 0.93
    nearest: int = 8
    shared: int = 2
    least_pivots: int = 64
    most_pivots: int = 4096
    spread: float = 0.7
    block: int = 1024


def choose_pivots(vectors: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """About sqrt(n) pivots of each dimension, from a sample by hash; sampled vectors near a chosen pivot are passed over,
    for a group of near copies must not supply most of the pivots. Frequent dimensions come first; from ``4 * most_pivots`` pivots on the others get none."""
    wanted: dict[int, tuple[int, int]] = {}
    left = 4 * index.most_pivots
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(left // index.least_pivots).collect()
    for dim, n in sizes:
        most = int(min(index.most_pivots, max(index.least_pivots, 2 ** np.ceil(np.log2(n**0.5)))))
        if most <= left:
            wanted[dim] = (most, n)
            left -= most
    if not wanted:
        return {}
    share = vectors.sparkSession.createDataFrame([(d, int(min(1, 4 * w / n) * SHARES)) for d, (w, n) in wanted.items()], "dim int, share long")
    place = F.pmod(F.xxhash64(F.lit(11), "rep"), F.lit(SHARES))
    sample = vectors.join(F.broadcast(share), "dim").where(place < F.col("share")).select("dim", "v", place.alias("at"), "rep").collect()
    pivots = {}
    for dim, (most, _) in wanted.items():
        rows = sorted((r.at, r.rep, bytes(r.v)) for r in sample if r.dim == dim)
        if rows:
            pivots[dim] = _apart(unit([v for *_, v in rows]), most, index.spread)
    return pivots


def _apart(pool: np.ndarray, most: int, spread: float) -> np.ndarray:
    chosen: list[int] = []
    best = np.full(len(pool), -1.0)
    for i in range(len(pool)):
        if len(chosen) < most and best[i] < spread:
            chosen.append(i)
            best = np.maximum(best, pool @ pool[i])
    return pool[chosen]


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def link_vectors(vectors: DataFrame, index: Index = Index()) -> DataFrame:
    """(vec_id, label, embedding) to (vec_id, n_links, component_id, kept): links are pairs of one label with cosine >= ``index.cosine``.

    1. Equal vectors of a label become one representative (smallest id) with a count; the rest works on representatives.
    2. Pivots are chosen for each dimension. Each representative is described by its ``nearest`` pivots in order, and put on the inverted list of each of them. Lists above ``block`` rows are split
       by a second pivot of the description, which loses no pair with two shared pivots; still longer ones are dealt out to pairs of blocks.
    3. In a list, pairs with ``shared`` pivots in common are verified in double precision, each pair on the list of its first shared pivots only.
       A task returns link counts and one edge for each member of a component, never the pairs.

    A null, zero, empty or not finite vector, or one without label, links with nothing. Rows of one vec_id count as one vector for components.
    Labels and ids other than whole numbers go by their 64-bit hash; the smallest id of each component is looked up at the end. A repeated row counts as another vector. Vectors of unlike length never link. A null vec_id gives n_links 0 and component null. An empty table gives an empty result.
    """
    if not isinstance(vectors.schema["vec_id"].dataType, T.IntegralType):
        return _by_hash(vectors, index)
    number = F.transform("embedding", lambda x: x.cast("double"))
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
        & ~F.coalesce(F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(F.exists(number, lambda x: x != 0), F.lit(False))
    )
    label = F.col("label").cast("long") if isinstance(vectors.schema["label"].dataType, T.IntegralType) else F.xxhash64("label")
    rows = vectors.select("vec_id", label.alias("label"), number.alias("x"), fine.alias("fine"))
    base = saved(rows.withColumns({"h1": F.xxhash64("label", "x"), "h2": F.xxhash64(F.lit(1), "x", "label")}))
    groups = saved(base.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("x").alias("x")))

    def packed(batch: pa.RecordBatch) -> dict:
        lists = batch.column("x").to_pylist()
        return {"rep": batch.column("rep"), "m": batch.column("m"), "label": batch.column("label"), "dim": [len(x) for x in lists], "v": [np.array(x, np.float64).tobytes() for x in lists]}

    reps = saved(map_rows(groups, "x", "rep long, m long, label long, dim int, v binary", packed))
    pivots = choose_pivots(reps, index)
    held = reps.sparkSession.sparkContext.broadcast(pivots)

    def described(batch: pa.RecordBatch) -> dict:
        p, out = held.value, []
        for v in batch.column("v").to_pylist():
            of = p.get(len(v) // 8)
            if of is None or len(of) < index.shared:
                out.append([-1 - i for i in range(index.shared)])  # a dimension without pivots: its vectors share one list, dealt out in blocks
                continue
            d = of @ unit([v])[0]
            out.append(np.lexsort((np.arange(len(d)), -d))[: index.nearest].tolist())
        return {c: batch.column(c) for c in ("rep", "m", "label", "dim", "v")} | {"near": out}

    told = saved(map_rows(reps, "v", "rep long, m long, label long, dim int, v binary, near array<int>", described))
    entry = told.withColumn("p", F.explode("near"))
    long_lists = saved(entry.groupBy("label", "dim", "p").count().where(F.col("count") > index.block).select("label", "dim", "p", F.lit(True).alias("long")))
    entry = lookup(entry, long_lists, ["label", "dim", "p"])
    second = F.when(F.col("long"), F.filter("near", lambda q: q > F.col("p"))).otherwise(F.array(F.lit(-9)))
    entry = entry.withColumn("q", F.explode(second)).drop("long")
    parts = saved(entry.groupBy("label", "dim", "p", "q").count().where(F.col("count") > index.block).select("label", "dim", "p", "q", F.ceil(F.col("count") / index.block).cast("int").alias("parts")))
    entry = lookup(entry, parts, ["label", "dim", "p", "q"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    entry = entry.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entry = entry.select("label", "dim", "p", "q", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "m", "v", "near")

    def compare(group: pa.Table) -> dict:
        p, q, lo, hi = (group.column(c)[0].as_py() for c in ("p", "q", "lo", "hi"))
        near = np.array(group.column("near").to_pylist())
        side = group.column("i").to_numpy()
        rep, m = group.column("rep").to_numpy(), group.column("m").to_numpy()
        v = unit(group.column("v").to_pylist())
        here, column = np.unique(near, return_inverse=True)
        has = np.zeros((len(rep), len(here)), np.float32)
        has[np.repeat(np.arange(len(rep)), near.shape[1]), column.ravel()] = 1
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(rep), 256):
            both = has[at : at + 256] @ has.T
            x, y = np.nonzero(both >= index.shared)
            x += at
            ok = (x < y) & ((side[x] != side[y]) if lo != hi else True)
            x, y = x[ok], y[ok]
            ok = np.einsum("ij,ij->i", v[x], v[y]) >= index.cosine
            x, y = x[ok], y[ok]
            for b in range(0, len(x), 65536):
                x1, y1 = x[b : b + 65536], y[b : b + 65536]
                common = np.where((near[x1][:, :, None] == near[y1][:, None, :]).any(2), near[x1], np.iinfo(np.int64).max)
                common.sort(axis=1)
                ok = (common[:, 0] == p) & ((common[:, 1] == q) if q != -9 else True)
                xs.append(x1[ok])
                ys.append(y1[ok])
        x, y = np.concatenate(xs), np.concatenate(ys)
        links = np.bincount(x, m[y], len(rep)) + np.bincount(y, m[x], len(rep))
        root = np.arange(len(rep))
        while True:  # smallest index that is linked, within this list
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(links)
        return {"rep": rep[some].tolist(), "links": links[some].astype(np.int64).tolist(), "root": rep[root[some]].tolist()}

    found = saved(map_groups(entry, ["label", "dim", "p", "q", "lo", "hi"], "rep long, links long, root long", compare))
    roots = saved(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    counts = saved(found.groupBy("rep").agg(F.sum("links").alias("links")))
    out = lookup(base.select("vec_id", "fine", "h1", "h2"), saved(groups.select("h1", "h2", "rep", "m")), ["h1", "h2"])
    out = out.withColumn("rep", F.when(F.col("fine"), F.col("rep")))
    out = lookup(lookup(out, counts, ["rep"]), roots.withColumnRenamed("v", "rep"), ["rep"])
    links = F.when(F.col("fine"), F.col("m") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", links.alias("n_links"), F.coalesce("root", "rep", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _by_hash(vectors: DataFrame, index: Index) -> DataFrame:
    """``link_vectors`` for ids of any type that has an order."""
    rows = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.xxhash64("vec_id")).alias("__h"), "label", "embedding")
    found = saved(link_vectors(rows.select(F.col("__h").alias("vec_id"), "label", "embedding"), index))
    names = saved(rows.where("vec_id is not null").select("__h", "vec_id").distinct())
    told = lookup(found.select(F.col("vec_id").alias("__h"), "n_links", F.col("component_id").alias("__c")), names, ["__h"])
    least = saved(told.groupBy("__c").agg(F.min("vec_id").alias("component_id")))
    return lookup(told, least, ["__c"]).select("vec_id", "n_links", "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_pivot_permutations(spark, sf_dir: str) -> DataFrame:
    """Links among all embeddings of one label from a cosine of 0.93 on."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
