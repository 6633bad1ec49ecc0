"""Substring dedup: suffixes in groups by prefixes of variable length, a suffix tree for each group, and its inner nodes from the depth of a window on."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.llm.common import WordHashes, grams, lookup, map_groups, map_rows, saved


@dataclass(frozen=True)
class Repeats:
    """``window``: words of a repeat; ``prefix``: words of the shortest prefixes that name groups; ``group``: most suffixes of which one tree is
    built. Where a group has more, its suffixes are split by longer prefixes, in steps up to the window.
    """

    window: int = 50
    prefix: int = 16
    group: int = 32_768

    @property
    def longer(self) -> list[int]:
        return sorted({self.prefix + (self.window - self.prefix) * i // 4 for i in (1, 2, 3)} - {self.prefix, self.window})


_HASHES = WordHashes()
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def runs_of(words: list[bytes], r: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, start, count): each suffix that starts a window goes to the group of the smallest prefix (by hash) among the
    suffixes that begin inside the window and have their prefix in it. Equal windows so come to the same group, and neighbouring suffixes mostly
    do too: a group gets the ``count`` suffixes from word ``start`` on as one stretch of text.
    """
    if len(words) < r.window:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
    g = grams(_HASHES.of(words), r.prefix)
    width = r.window - r.prefix + 1
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(1) + np.arange(len(g) - width + 1)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[starts]], starts, np.diff(np.append(starts, len(at)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def suffix_order(stretches: list[list[bytes]], first_only: bool, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lcp, begins): the places of the suffixes that have ``window`` words (of each stretch the first only, if asked), in the order of their words; the
    number of words each shares with the one before it; where the stretches begin.

    Places number the words of all stretches, each with an end mark that equals nothing. Ranks of 1, 2, 4, ... words from each place on (prefix doubling)
    give the order, and the common prefixes by halving steps.
    """
    sizes = np.array([len(s) for s in stretches])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    code: dict[bytes, int] = {}
    flat = [code.setdefault(w, len(code)) for s in stretches for w in s]
    marks = begins + sizes
    words = np.ones(len(flat) + len(stretches), bool)
    words[marks] = False
    codes = np.empty(len(words), np.int32)
    codes[words], codes[marks] = flat, len(code) + np.arange(len(stretches))
    ranks = [codes]
    while 1 << (len(ranks) - 1) <= sizes.max():
        r, step = ranks[-1].astype(np.int64), 1 << (len(ranks) - 1)
        ahead = np.zeros_like(r)
        ahead[:-step] = r[step:]
        ranks.append(np.unique(r * (int(r.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int32))
    if first_only:
        places = begins[sizes >= window]
    else:
        here = np.arange(len(words))
        places = here[here <= (marks - window)[np.searchsorted(begins, here, side="right") - 1]]
    order = places[np.argsort(ranks[-1][places], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        same = ranks[k][order[:-1] + lcp[1:]] == ranks[k][order[1:] + lcp[1:]]
        lcp[1:] += same * (1 << k)
    return order, lcp, begins


def depths(owners: list[int], lcp: list[int]) -> list[int]:
    """For each leaf the depth of its deepest inner node that also holds an earlier leaf of a smaller owner; 0 if there is none.

    The stack holds leaves of rising owners, each with the depth of the node that joins it and the leaf below it.
    """
    out, stack = [], []
    for owner, depth in zip(owners, lcp):
        while stack and stack[-1][0] >= owner:
            depth = min(depth, stack.pop()[1])
        out.append(depth if stack else 0)
        stack.append((owner, depth))
    return out


def deep_repeats(stretches: list[list[bytes]], owners: list, first_only: bool, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, word, length): the longest repeats, of ``window`` words at least, that a stretch shares with one of a smaller owner.

    The leaves in order with their common prefixes are the suffix tree. A suffix repeats as far as the deepest inner node above it reaches
    that also has a leaf of a smaller owner, before or after it; of suffixes that end alike only the longest is given.
    """
    order, lcp, begins = suffix_order(stretches, first_only, window)
    deep = lcp >= window
    some = np.flatnonzero(deep | np.append(deep[1:], False))
    if not len(some):
        return (np.empty(0, np.int64),) * 3
    rank = {o: i for i, o in enumerate(sorted(set(owners)))}
    of = np.array([rank[o] for o in owners])
    order, near = order[some], np.where(deep, lcp, 0)[some]
    stretch = np.searchsorted(begins, order, side="right") - 1
    leaf = of[stretch].tolist()
    before = depths(leaf, near.tolist())
    after = depths(leaf[::-1], [0, *near[:0:-1].tolist()])[::-1]
    length = np.zeros(int(order.max()) + 2, np.int64)
    length[order + 1] = np.maximum(before, after)
    at = np.flatnonzero((length[1:] >= window) & (length[:-1] <= length[1:]))
    stretch = np.searchsorted(begins, at, side="right") - 1
    return stretch, at - begins[stretch], length[at + 1]


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def scan_documents(rows: DataFrame, r: Repeats) -> DataFrame:
    """(id, th, text binary) to (id, th, n, w1, w2, sha, runs): number, digest and prefixes of the words."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("n", "w1", "w2", "sha", "runs")}
        for text in batch.column("text").to_pylist():
            words = text.split() if text else []
            whole = b" ".join(words)
            d = xxhash.xxh3_128_intdigest(whole)
            g, s, c = runs_of(words, r)
            out["n"].append(len(words))
            out["w1"].append(signed(d >> 64))
            out["w2"].append(signed(d & ((1 << 64) - 1)))
            out["sha"].append(hashlib.sha256(whole).hexdigest())
            out["runs"].append([{"g": x, "s": y, "c": z} for x, y, z in zip(g.view(np.int64).tolist(), s.tolist(), c.tolist())])
        return {"id": batch.column("id"), "th": batch.column("th")} | out

    return map_rows(rows, "text", f"id {_kind(rows)}, th long, n int, w1 long, w2 long, sha string, runs array<struct<g:long,s:int,c:int>>", run)


def stretches_of(candidates: DataFrame, r: Repeats, with_text: bool) -> DataFrame:
    """The stretch of text of each run: (g, q, id, th, s, c[, text]); q is a hash of the stretch."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("g", "q", "id", "th", "s", "c", "stretch")}
        for i, th, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text", "runs"))):
            words = text.split()
            for x in runs:
                stretch = b" ".join(words[x["s"] : x["s"] + x["c"] + r.window - 1])
                for c, v in (("g", x["g"]), ("q", signed(xxhash.xxh3_64_intdigest(stretch))), ("id", i), ("th", th), ("s", x["s"]), ("c", x["c"]), ("stretch", stretch if with_text else None)):
                    out[c].append(v)
        return out

    return map_rows(candidates, "text", f"g long, q long, id {_kind(candidates)}, th long, s int, c int, stretch binary", run)


#: Repeats of a stretch: first word, number of words.
HIT = "array<struct<j:int,n:int>>"
HITS = f"g long, q long, hits {HIT}"


def grow(groups: pa.Table, r: Repeats) -> dict:
    """The repeats of each stretch, by the suffix trees of the groups. One call orders the suffixes of several groups: those that agree on a window lie in one group,
    so that trees don't meet from that depth on. With a column ``j`` a row is the one suffix of its stretch from word j on."""
    stretches, first_only = [t.split(b" ") for t in groups.column("stretch").to_pylist()], "j" in groups.column_names
    skip = groups.column("j").to_pylist() if first_only else [0] * len(stretches)
    found: dict[int, list[dict]] = {}
    for i, j, n in zip(*(x.tolist() for x in deep_repeats([w[k:] for w, k in zip(stretches, skip)], groups.column("owner").to_pylist(), first_only, r.window))):
        found.setdefault(i, []).append({"j": skip[i] + j, "n": n})
    some = groups.take(pa.array(list(found), pa.int64()))
    return {"g": some.column("g").to_pylist(), "q": some.column("q").to_pylist(), "hits": list(found.values())}


def split_groups(large: DataFrame, r: Repeats) -> tuple[DataFrame, DataFrame]:
    """(parts, nodes) of groups (g, q, owner, count, stretch) with too many suffixes. Parts (p, g, q, owner, j, stretch) name each suffix's new group: the shortest
    of its own prefixes that no more than ``group`` suffixes share. Nodes are the (g, q, hits) of suffixes that so many share up to the whole window."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("g", "q", "owner", "j", "names", "k1", "k2")}
        for g, q, owner, stretch in zip(*(batch.column(c).to_pylist() for c in ("g", "q", "owner", "stretch"))):
            words = stretch.split(b" ")
            h = _HASHES.of(words)
            n = len(words) - r.window + 1
            names = np.stack([grams(h, length)[:n] for length in (r.longer or [r.window])], 1).view(np.int64)
            digests = [xxhash.xxh3_128_intdigest(b" ".join(words[j : j + r.window])) for j in range(n)]
            for c, v in (("g", [g] * n), ("q", [q] * n), ("owner", [owner] * n), ("j", range(n)), ("names", names.tolist())):
                out[c] += v
            out["k1"] += [signed(d >> 64) for d in digests]
            out["k2"] += [signed(d & ((1 << 64) - 1)) for d in digests]
        return out

    owner = large.schema["owner"].dataType.simpleString()
    rest = saved(map_rows(large, "stretch", f"g long, q long, owner {owner}, j int, names array<long>, k1 long, k2 long", run))
    parts = []
    for i in range(len(r.longer)):
        named = rest.withColumn("p", F.element_at("names", i + 1))
        sizes = named.groupBy("p").agg(F.count("*").alias("n"), F.min("owner").alias("a"), F.max("owner").alias("z")).where("a < z")
        named = saved(lookup(named, saved(sizes.select("p", (F.col("n") <= r.group).alias("fits"))), ["p"], "inner", 1_000_000))
        parts.append(named.where("fits").select("p", "g", "q", "owner", "j"))
        rest = named.where("not fits").drop("p", "fits")
    whole = saved(rest.groupBy("k1", "k2").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("k1", "k2", "least"))
    hit = F.struct("j", F.lit(r.window).alias("n"))
    nodes = saved(lookup(rest, whole, ["k1", "k2"], "inner", 1_000_000).where("least < owner").groupBy("g", "q").agg(F.collect_list(hit).alias("hits")))
    some = reduce(DataFrame.union, parts, rest.where("false").select(F.col("k1").alias("p"), "g", "q", "owner", "j"))
    return some.join(large.select("g", "q", "stretch"), ["g", "q"]).select("p", "g", "q", "owner", "j", "stretch"), nodes


def find_repeats(docs: DataFrame, r: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, candidates, ranges): every row's scan with ``copy`` (its words are those of a smaller id); the rows with repeated prefixes
    (id, th, text); and the word ranges (id, th, start, end) that windows of smaller ids cover.

    1. One scan names each suffix's group by a prefix and keeps (prefix, start, count) only. Documents with equal words collapse to the smallest id.
    2. Prefixes that occur in two documents at least are the ones whose groups can have deep nodes; only their stretches of text are made.
    3. Equal stretches collapse to the smallest id, so that a passage in a third of all documents costs a row each, not a tree of that size.
    4. The suffixes of a group make a suffix tree, whose inner nodes from the depth of a window on are the repeats. Where a group has over ``group``
       suffixes, these are split by their own prefixes, which grow until each group fits; at the length of a window a group is one node.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("text"))
    scan = saved(scan_documents(rows, r))
    copies = saved(scan.where("id is not null and n > 0").groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w1", "w2", "least"))
    scan = saved(lookup(scan, copies, ["w1", "w2"]).withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("least", "w1", "w2"))
    runs = scan.where("not copy and id is not null").select("id", "th", F.inline("runs"))
    common = saved(runs.groupBy("g").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("g"))
    wanted = saved(lookup(runs, common, ["g"], "inner", 1_000_000).groupBy("id", "th").agg(F.collect_set(F.struct("g", "s", "c")).alias("runs")))
    candidates = saved(rows.join(wanted, ["id", "th"]))
    different = saved(stretches_of(candidates, r, True).groupBy("g", "q").agg(F.min("id").alias("owner"), F.first("c").alias("count"), F.first("stretch").alias("stretch")))
    groups = different.groupBy("g").agg(F.sum("count").alias("n"), F.min("owner").alias("a"), F.max("owner").alias("z")).where("a < z")
    groups = saved(groups.select("g", (F.col("n") <= r.group).alias("fits")))
    sized = lookup(different, groups, ["g"], "inner", 1_000_000)
    found = map_groups(sized.where("fits").select("g", "q", "owner", "stretch"), ["g"], HITS, lambda t: grow(t, r), together=True)
    if groups.where("not fits").isEmpty():
        hits = saved(found)
    else:
        parts, nodes = split_groups(saved(sized.where("not fits").drop("fits")), r)
        more = map_groups(parts, ["p"], HITS, lambda t: grow(t, r), together=True)
        hits = saved(saved(found).union(saved(more)).union(nodes).groupBy("g", "q").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    owners = saved(different.select("g", "q", "owner").join(hits, ["g", "q"], "left"))
    own = stretches_of(candidates, r, False).drop("stretch")
    met = own.join(owners.withColumnsRenamed({"g": "g2", "q": "q2"}), (F.col("g") == F.col("g2")) & (F.col("q") == F.col("q2")))
    whole = F.array(F.struct(F.col("s").alias("start"), (F.col("s") + F.col("c") + r.window - 1).alias("end")))
    parts = F.transform(F.coalesce("hits", F.array().cast(HIT)), lambda x: F.struct((F.col("s") + x["j"]).alias("start"), (F.col("s") + x["j"] + x["n"]).alias("end")))
    ranges = met.select("id", "th", F.when(F.col("id") > F.col("owner"), whole).otherwise(parts).alias("x")).where(F.size("x") > 0)
    return scan, candidates, saved(ranges.groupBy("id", "th").agg(F.flatten(F.collect_list("x")).alias("ranges")))


def cut(words: list[bytes], ranges: list[dict]) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    for x in ranges:
        gone[x["start"]] += 1
        gone[x["end"]] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def dedup_substrings(docs: DataFrame, r: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's (doc_id, n_words, n_removed, kept_text_sha256 as kept_sha256) after removing every word inside a window of ``window`` words that also starts
    in a document of a smaller id. Windows are judged on the input.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or empty text has no words. A null doc_id is neither smaller nor larger than others: nothing is
    removed from such rows, nor because of them. Rows of one doc_id never remove words from each other. Ids may be of any type with an order. An empty table gives an empty result.
    """
    scan, candidates, ranges = find_repeats(docs, r, doc_id, text)

    def finish(batch: pa.RecordBatch) -> dict:
        n, sha = [], []
        for t, x in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            words = t.split()
            kept = cut(words, x)
            n.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"id": batch.column("id"), "th": batch.column("th"), "removed": n, "kept_sha": sha}

    touched = candidates.select("id", "th", "text").dropDuplicates(["id", "th"]).join(ranges, ["id", "th"])
    cuts = saved(map_rows(touched, "text", f"id {_kind(touched)}, th long, removed long, kept_sha string", finish))
    out = lookup(scan.select("id", "th", "n", "sha", "copy"), cuts, ["id", "th"])
    all_gone = F.col("copy") & (F.col("n") >= r.window)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_words"),
        F.when(all_gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, EMPTY_SHA).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def op7_prefix_suffix_trees(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words in all documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
