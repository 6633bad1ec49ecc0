"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltloom.llm.common import saved

#: A key is two numbers of 60 bits, read as ten digits of 12 bits.
DIGIT, DIGITS = 12, 5
#: Rows that a task numbers at most, on average.
ROWS_PER_BIN = 20_000


@dataclass(frozen=True)
class Splitter:
    """First key (text hash, id hash, and number of the row where rows are alike) of a shard, and the bytes that lie below it."""

    key: tuple[int, ...]
    below: int


def sort_key(text: Column, doc_id: Column) -> tuple[Column, Column]:
    """Equal texts are neighbours in key order; the id's hash orders them."""
    t = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), 4)
    return t, F.shiftrightunsigned(F.xxhash64(F.lit(7), doc_id), 4)


def find_splitters(keyed: DataFrame, keys: list[str], shards: int, tolerance: float, group_tolerance: float) -> tuple[list[Splitter], bool, int]:
    """Splitters for ``keyed`` (keys, size), whether rows equal in all keys kept none from its place, and the number of rows.

    Each round counts the exact bytes of 4,096 candidate ranges inside every open range (one for each splitter at most),
    so that at most 4,096 x (shards - 1) sums reach the driver. A splitter is settled by the nearest
    range boundary as soon as that is within ``tolerance`` of a mean shard, or when the key has no digits left. A group of equal texts
    is cut only where both its ends are further off than ``group_tolerance``.
    """
    levels, exact = len(keys) * DIGITS, True
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    allowed = tolerance * total / shards
    done: dict[int, Splitter] = {}
    open_at: dict[int, tuple[tuple[int, ...], int]] = {i: ((), 0) for i in range(1, shards)} if total else {}
    for level in range(levels):
        if not open_at:
            break
        prefixes = sorted({p for p, _ in open_at.values()})
        col, left = keys[level // DIGITS], DIGITS - level % DIGITS
        number = {p: j for j, p in enumerate(prefixes)}
        which = F.lit(None).cast("int")
        for p in prefixes:
            which = F.when(_has_prefix(p, keys), number[p]).otherwise(which)
        counts = (
            keyed.select(which.alias("p"), F.shiftright(col, DIGIT * (left - 1)).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int").alias("d"), "size")
            .where("p is not null").groupBy("p", "d").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
        )
        by: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted((r.p, r.d, r.n, r.rows) for r in counts):
            by.setdefault(r[0], []).append(r[1:])
        still = {}
        for i, (p, below) in open_at.items():
            goal, at = total * i / shards, below
            for d, n, alike in by[number[p]]:
                if at + n >= goal:
                    break
                at += n
            low, high = (at, (*p, d)), (at + n, _after((*p, d)))
            best = min(low, high, key=lambda x: abs(x[0] - goal))
            near = group_tolerance * total / shards if level == DIGITS - 1 else allowed
            if abs(best[0] - goal) <= near or level == levels - 1:
                exact &= abs(best[0] - goal) <= near or alike == 1
                done[i] = Splitter(_numbers(best[1], len(keys)), best[0])
            else:
                still[i] = ((*p, d), at)
        open_at = still
    return [done[i] for i in sorted(done)], exact, rows


def _numbers(digits: tuple[int, ...], keys: int) -> tuple[int, ...]:
    parts = [0] * keys
    for j, d in enumerate((*digits, *[0] * (keys * DIGITS - len(digits)))):
        parts[j // DIGITS] = (parts[j // DIGITS] << DIGIT) + d
    return tuple(parts)


def _after(digits: tuple[int, ...]) -> tuple[int, ...]:
    """The first digits behind a range; a carry may make the leading digit 4,096, which is above all keys."""
    out = list(digits)
    out[-1] += 1
    for j in range(len(out) - 1, 0, -1):
        if out[j] == 1 << DIGIT:
            out[j] = 0
            out[j - 1] += 1
    return tuple(out)


def _has_prefix(p: tuple[int, ...], keys: list[str]) -> Column:
    out = F.lit(True)
    for j, col in enumerate(keys):
        part = p[j * DIGITS : (j + 1) * DIGITS]
        if part:
            out = out & (F.shiftright(F.col(col), DIGIT * (DIGITS - len(part))) == F.lit(_numbers((*[0] * (DIGITS - len(part)), *part), 1)[0]))
    return out


def _from(columns: list[Column], key: tuple[int, ...]) -> Column:
    """The columns, read as one key, are ``key`` or above it."""
    first, value = columns[0], F.lit(key[0])
    return (first > value) | ((first == value) & _from(columns[1:], key[1:])) if len(key) > 1 else first >= value


def shard_by_bytes(df: DataFrame, shards: int = 16, tolerance: float = 0.001, group_tolerance: float = 0.1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with ``shard`` (0 .. shards - 1) and ``slot`` (0, 1, ... inside each shard, without gaps).

    Shards hold nearly equal bytes, a row counting its UTF-8 length plus 1. Rows are ordered by hash of the text, then of the id,
    and cut at splitters; equal texts stay together unless that would move a boundary by over ``group_tolerance`` of a mean shard.
    A null text counts as no bytes and differs from an empty one; null ids count as equal. Only where rows equal in text and id keep a boundary from
    its place, all rows are written out with a number each, by whose hash such rows are parted.
    An empty table gives an empty result. Columns of ``df`` named shard or slot are replaced.
    The rows are exchanged once, by shard and bin; slots follow the bins, whose counts are summed up beforehand.
    """
    t, k = sort_key(F.col(text), F.col(doc_id))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    keys, own = ["__t", "__k"], df.drop("shard", "slot").withColumns({"__t": t, "__k": k})
    slim = saved(own.select(*keys, size.alias("size")))
    splitters, exact, rows = find_splitters(slim, keys, shards, tolerance, group_tolerance)
    if not exact:
        own = saved(own.withColumn("__r", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)))
        keys = [*keys, "__r"]
        slim = own.select(*keys, size.alias("size"))
        splitters, _, rows = find_splitters(slim, keys, shards, tolerance, group_tolerance)
    bins = max(1, -(-rows // (shards * ROWS_PER_BIN)))

    def placed(d: DataFrame) -> DataFrame:
        at = sum((_from([F.col(c) for c in keys], s.key).cast("int") for s in splitters), F.lit(0))
        return d.withColumn("shard", at).withColumn("__bin", F.pmod(F.xxhash64(*keys), F.lit(bins)).cast("int"))

    counts = placed(slim).groupBy("shard", "__bin").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    starts = saved(counts.select("shard", "__bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))
    inside = W.partitionBy("shard", "__bin").orderBy(*keys)
    numbered = placed(own).withColumn("__n", F.row_number().over(inside))
    small = shards * bins <= 100_000
    return (
        numbered.join(F.broadcast(starts) if small else starts, ["shard", "__bin"])
        .withColumn("slot", (F.col("__start") + F.col("__n") - 1).cast("long"))
        .select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def op6_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes (law ``bytes``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_by_bytes(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
