"""MinHash near-duplicates by fast similarity sketching, banding and exact verification on full shingle sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.llm.common import LOWER, WordHashes, components, grams, lookup, map_groups, map_rows, mix, saved


@dataclass(frozen=True)
class Near:
    """What counts as a near duplicate: 100 * intersection >= percent * union of word shingle sets.

    A pair of similarity s shares one of ``bands`` with probability 1 - (1 - s ** rows) ** bands: above 0.99999 at 0.85, 0.9996 at 0.8.
    ``block``: most members of a bucket that are compared with each other at once.
    """

    shingle: int = 3
    percent: int = 85
    bands: int = 20
    rows: int = 5
    block: int = 512

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_HASHES = WordHashes()


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it has fewer words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(grams(_HASHES.of(words), min(n, len(words))))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch: in round i < t each item falls into one hashed bin with value i + fraction; in round t + j all
    items fall into bin j. A bin keeps its smallest value; later rounds can't change a full bin. Rounds end when all bins are full.
    """
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 40) - 1)
    step = 2 * t if len(items) < 64 else 1
    for first in range(0, 2 * t, step):
        rounds = np.arange(first, min(first + step, 2 * t), dtype=np.uint64)
        h = mix(np.broadcast_to(items, (len(rounds), len(items))).copy(), (rounds + np.uint64(1))[:, None] * np.uint64(0xD6E8FEB86659FD93))
        bins = ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64)
        late = rounds >= t
        bins[late] = (rounds[late] - np.uint64(t)).astype(np.int64)[:, None]
        np.minimum.at(out, bins.ravel(), ((rounds << np.uint64(40))[:, None] + (h & low)).ravel())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """(id, text as binary) to (id, n, s1, s2, bands): set size, 128-bit digest of the set and band keys."""

    def run(batch: pa.RecordBatch) -> dict:
        n, s1, s2, bands = [], [], [], []
        for text in batch.column("text").to_pylist():
            items = shingles(text, near.shingle)
            n.append(len(items))
            d = xxhash.xxh3_128_intdigest(items.tobytes())
            s1.append((d >> 64) - (1 << 63))
            s2.append((d & ((1 << 64) - 1)) - (1 << 63))
            if not len(items):
                bands.append([])
                continue
            values = sketch(items, near.coordinates)
            keys = np.zeros(near.bands, np.uint64)
            for j in range(near.rows):
                keys = mix(keys, values[j :: near.rows])
            bands.append(keys.view(np.int64))
        return {"id": batch.column("id"), "n": n, "s1": s1, "s2": s2, "bands": bands}

    return map_rows(docs, "text", "id long, n int, s1 long, s2 long, bands array<long>", run)


def full_sets(docs: DataFrame, wanted: DataFrame, near: Near) -> DataFrame:
    """Full shingle sets of the wanted (id, s1, s2) as (id, items)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(text, near.shingle) for text in batch.column("text").to_pylist()]
        own = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
        ok = [(d >> 64) - (1 << 63) == a and (d & ((1 << 64) - 1)) - (1 << 63) == b for d, a, b in zip(own, batch.column("s1").to_pylist(), batch.column("s2").to_pylist())]
        return {"id": batch.column("id"), "items": [x.view(np.int64) if y else None for x, y in zip(sets, ok)]}

    return map_rows(lookup(docs, wanted, ["id"], "inner"), "text", "id long, items array<long>", run).where("items is not null")


def verify(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that are near duplicates by their full sets."""
    a, b = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= near.percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _open_links(rows: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) within the buckets (k, id, root) that hold several components: all members of a bucket are compared on their full sets.

    Buckets with equal members are compared once. A bucket of over ``near.block`` members is dealt out to pairs of blocks. A task returns
    for each linked member one edge to the smallest one it is connected with, never the pairs.
    """
    sizes = rows.groupBy("k").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same"))
    once = sizes.where("r0 < r1").groupBy("m", "r0", "r1", "same").agg(F.min("k").alias("k"))
    sizes = saved(once.select("k", F.ceil(F.col("m") / near.block).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = lookup(rows.select("k", "id"), sizes, ["k"], "inner").withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = saved(dealt.select("k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "id"))
    members = dealt.join(sets, "id").select("k", "lo", "hi", "id", F.array_sort("items").alias("items"))

    def run(group: pa.Table) -> dict:
        ids = group.column("id").to_numpy()
        lists = group.column("items").combine_chunks()
        a, b = linked(ids, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), near)
        return {"a": a, "b": b}

    return map_groups(members, ["k", "lo", "hi"], "a long, b long", run)


def linked(ids: np.ndarray, sizes: np.ndarray, items: np.ndarray, near: Near) -> tuple[list[int], list[int]]:
    """Edges that connect the near duplicates of a group as all its pairs do. The sets follow each other in ``items``.

    Intersections of all pairs are products of the sets' incidence matrix, taken over some thousand items at a time.
    """
    owner = np.repeat(np.arange(len(ids)), sizes)
    values, at, count = np.unique(items, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1  # an item of one set is in no intersection
    common = (count > 1)[at]
    owner, at = owner[common], new[at[common]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(ids), len(ids)), np.float32)
    width = max(256, (4 << 20) // len(ids))
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        x, y = np.searchsorted(at, (first, first + width))
        has = np.zeros((len(ids), width), np.float32)
        has[owner[x:y], at[x:y] - first] = 1
        both += has @ has.T
    ok = 100 * both >= near.percent * (sizes[:, None] + sizes[None, :] - both)
    ok &= ids[:, None] != ids[None, :]
    x, y = np.nonzero(np.triu(ok, 1))
    root = np.arange(len(ids))
    while len(x):
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    far = np.flatnonzero(root != np.arange(len(ids)))
    return ids[far].tolist(), ids[root[far]].tolist()


def near_duplicates(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's (doc_id, n_shingles, component_id, kept): the connected components of near duplicates.

    1. Sketch every text once; rows with equal sets (by a 128-bit digest of the full set) are one vertex, named by the smallest id.
    2. In each bucket (band, key) link candidates are the smallest id with every other one: as many as rows.
    3. Full sets of the candidates are made once; a pair is linked only when these agree.
    4. Buckets that still span components compare all their members on full sets, in blocks inside tasks. So a group of copies costs
       about one pair a member, and no pair that shares a bucket is missed.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Texts without words (or null) have no shingles and are linked with nothing;
    rows with a null id keep component null and stay. Rows of one id count as one document: it links to whatever any of them does.
    Ids other than whole numbers go by their 64-bit hash, and the smallest id of each component is looked up at the end.
    An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, T.IntegralType):
        named = docs.withColumn("__v", F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)))
        found = near_duplicates(named.select(F.col("__v").alias("doc_id"), F.col(text).alias("text")), near)
        found = saved(found.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("c")).where("doc_id is not null"))
        ids = saved(named.where("__v is not null").select("__v", F.col(doc_id).alias("id")).distinct())
        least = ids.join(found, ids["__v"] == found["doc_id"]).groupBy("c").agg(F.min("id").alias("least"))
        sized = map_rows(named.select(F.col("__v"), F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")), "text", T.StructType([T.StructField("__v", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType())]), lambda b: {"__v": b.column("__v"), "id": b.column("id"), "n": [len(shingles(x, near.shingle)) for x in b.column("text").to_pylist()]})
        out = lookup(lookup(sized, found.select(F.col("doc_id").alias("__v"), "c"), ["__v"]), saved(least), ["c"])
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    sk = saved(sketches(rows, near))
    real = sk.where("n > 0 and id is not null")
    copies = saved(real.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("s1", "s2", "rep"))
    named = saved(lookup(real, copies, ["s1", "s2"]).withColumn("rep", F.coalesce("rep", "id")).where("rep = id").dropDuplicates(["id", "s1", "s2"]).drop("rep"))
    buckets = named.select("id", "n", F.posexplode("bands").alias("band", "key")).select("id", "n", F.xxhash64("band", "key").alias("k"))
    shared = saved(buckets.groupBy("k").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("c")).where("c > 1").select("k", F.col("first.id").alias("a"), F.col("first.n").alias("na")))
    members = saved(lookup(buckets, shared, ["k"], "inner"))
    fits = 100 * F.least("n", "na") >= near.percent * F.greatest("n", "na")
    first = saved(members.where(fits & (F.col("a") != F.col("id"))).select("a", F.col("id").alias("b")).distinct())
    wanted = saved(members.select("id").distinct())
    wanted = saved(lookup(named.select("id", "s1", "s2"), wanted, ["id"], "inner"))
    sets = saved(full_sets(rows, wanted, near))
    links = saved(verify(first, sets, near).distinct())
    roots = saved(components(links))
    labelled = lookup(members.select("k", "id"), roots.withColumnRenamed("v", "id"), ["id"]).withColumn("root", F.coalesce("root", "id"))
    more = saved(_open_links(labelled, sets, near))
    if not more.isEmpty():
        roots = saved(components(links.union(more)))
    placed = lookup(sk.select("id", "n", "s1", "s2"), copies, ["s1", "s2"]).withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    placed = lookup(placed, roots.withColumnRenamed("v", "rep"), ["rep"])
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep"))
    return placed.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_fast_similarity_sketch(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 3-word shingles, similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
