"""Mixing overlapping sources to target weights: min-cost flow over membership patterns, then seeded choice of documents."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltloom.llm.common import lookup, saved

#: Cost of a token's first, second and third use; rising costs spread repetition evenly.
COSTS = (0, 1, 3)
DIGIT = 4096
WORD = r"[^\x20\x09-\x0D]+"


def quotas(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Target of each source: its weight's share of all sizes, at most ``most`` times its size; the excess goes to the others by weight.

    Weights repeat over the sources in code-point order, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, total = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def route(patterns: list[tuple[tuple[str | None, ...], int]], need: dict[str | None, int], costs: Sequence[int] = COSTS) -> list[dict[str | None, int]]:
    """Tokens that each pattern gives to each of its sources: a min-cost flow of largest value.

    Network: start -> pattern (one arc of the pattern's size for each use, at rising cost) -> its sources -> end (quota).
    Shortest paths with potentials; all paths of one cost are filled together, level by level, so that there are as many searches for the
    shortest one as costs, and the work follows the arcs of the aggregated graph, not the documents.
    """
    sources = sorted(need, key=lambda s: (s is None, s or ""))
    first = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, room, price in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(room)
            cost.append(price)
        return len(to) - 2

    given: list[dict[str | None, int]] = []
    total = sum(n for _, n in patterns) * len(costs)
    for p, (members, size) in enumerate(patterns):
        for w in costs:
            arc(0, 2 + p, size, w)
        given.append({s: arc(2 + p, first[s], total, 0) for s in members})
    for s in sources:
        arc(first[s], 1, need[s], 0)
    height = [0] * len(graph)
    while _raise(height, graph, to, cap, cost):
        free = lambda a, e: cap[e] and not cost[e] + height[a] - height[to[e]]
        while level := _levels(graph, to, free):
            _fill(graph, to, cap, level, free)
    return [{s: cap[e ^ 1] for s, e in g.items()} for g in given]


def _raise(height: list[int], graph: list[list[int]], to: list[int], cap: list[int], cost: list[int]) -> bool:
    """Raise the potentials so that the arcs of all shortest paths with room cost nothing; False if no path is left."""
    dist, queue = {0: 0}, [(0, 0)]
    while queue:
        d, a = heapq.heappop(queue)
        if a == 1:
            break
        if d > dist[a]:
            continue
        for e in graph[a]:
            if cap[e] and (x := d + cost[e] + height[a] - height[to[e]]) < dist.get(to[e], 1 << 62):
                dist[to[e]] = x
                heapq.heappush(queue, (x, to[e]))
    if 1 not in dist:
        return False
    for a in range(len(graph)):
        height[a] += min(dist.get(a, dist[1]), dist[1])
    return True


def _levels(graph: list[list[int]], to: list[int], free: Callable[[int, int], bool]) -> dict[int, int] | None:
    """Number of free arcs from the start to each node; None if they don't reach the end."""
    level, row = {0: 0}, [0]
    while row and 1 not in level:
        below: list[int] = []
        for a in row:
            for e in graph[a]:
                if to[e] not in level and free(a, e):
                    level[to[e]] = level[a] + 1
                    below.append(to[e])
        row = below
    return level if 1 in level else None


def _fill(graph: list[list[int]], to: list[int], cap: list[int], level: dict[int, int], free: Callable[[int, int], bool]) -> None:
    """Push flow along free arcs that lead one level on, until each such path has a full arc. A node's arcs are tried once."""
    tried = [0] * len(graph)
    path: list[int] = []
    a = 0
    while True:
        if a == 1:
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow
            full = next(i for i, e in enumerate(path) if not cap[e])
            a = to[path[full] ^ 1]
            del path[full:]
        while tried[a] < len(graph[a]) and not (level.get(to[graph[a][tried[a]]]) == level[a] + 1 and free(a, graph[a][tried[a]])):
            tried[a] += 1
        if tried[a] < len(graph[a]):
            path.append(graph[a][tried[a]])
            a = to[path[-1]]
        elif path:
            a = to[path.pop() ^ 1]
            tried[a] += 1
        else:
            return


#: Names of columns that the mix uses inside.
_OWN = frozenset("pattern h d1 d2 passes rest more taken edge_d1 left_d1 edge_d2 left_d2".split())


def mix_sources(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), costs: Sequence[int] = COSTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Mix documents (id, sources array, size, any other columns) to the weights' shares of all sizes.

    Returns the documents with ``pattern`` and ``taken`` (tokens, repeats counted, at most len(costs) x size), and the flow
    (pattern, source, source_size, target, tokens). A document belongs to every source in its array; its size counts for each of them.
    Documents with an equal set of sources form a pattern. Patterns and sources are read to the driver: they are aggregates, with one row for
    each set of sources that occurs. A pattern that gives q passes and a rest takes each document q times, then in the order of a
    seeded hash until the rest is used; the last document gives only its first words, so that quotas are met exactly. A null array counts as [null];
    sizes of 0 or null take nothing; an empty table gives empty results; other columns stay as they are, but for ones named ``pattern`` and ``taken``, which are replaced. Rows equal in id may share a hash and follow each other.
    """
    others = [c for c in rows.columns if c not in ("id", "sources", "size")]
    if _OWN & set(others):  # they wait in a struct until the end
        packed, report = mix_sources(rows.select("id", "sources", "size", F.struct(*others).alias("__others")), weights, costs, seed)
        kept = [F.col(f"__others.{c}").alias(c) for c in others if c not in ("pattern", "taken")]
        return packed.select("pattern", "id", "sources", "size", *kept, "taken"), report
    named = (
        rows.withColumn("sources", F.array_sort(F.array_distinct(F.coalesce("sources", F.array(F.lit(None).cast("string")))))).withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
        .withColumn("pattern", F.to_json("sources", {"ignoreNullFields": "false"})).withColumn("h", F.xxhash64(F.lit(seed), "id"))
        .withColumn("d1", F.pmod("h", F.lit(DIGIT)).cast("int")).withColumn("d2", F.pmod(F.shiftright("h", 12), F.lit(DIGIT)).cast("int"))
    )
    base = saved(named.select("sources", "size", "pattern", "d1", "d2"))
    spark = rows.sparkSession
    found = sorted((r.pattern, tuple(r.sources), r.n) for r in base.groupBy("pattern", "sources").agg(F.sum("size").alias("n")).collect())
    sizes: dict[str | None, int] = {}
    for _, members, n in found:
        for s in members:
            sizes[s] = sizes.get(s, 0) + n
    patterns = [(members, n) for _, members, n in found]
    whole = sum(n for _, n in patterns)
    scale = whole / sum(sizes.values()) if sum(sizes.values()) else 1.0  # overlapping sources share the documents' tokens
    target = {s: t * scale for s, t in quotas(sizes, weights, len(costs)).items()} if sizes else {}
    flows = route(patterns, {s: round(t) for s, t in target.items()}, costs)
    report = spark.createDataFrame(
        [(found[p][0], s, sizes[s], float(target[s]), f) for p, out in enumerate(flows) for s, f in out.items()], "pattern string, source string, source_size long, target double, tokens long"
    )
    plan = saved(spark.createDataFrame([(found[p][0], sum(out.values()) // n if n else 0, sum(out.values()) % n if n else 0) for p, (out, (_, n)) in enumerate(zip(flows, patterns))], "pattern string, passes long, rest long"))
    return _select(named, base, plan).select("pattern", *rows.columns, "taken"), report


def _select(rows: DataFrame, base: DataFrame, plan: DataFrame) -> DataFrame:
    """``taken`` of each document: histograms of the hash (4,096 ranges, then 4,096 inside the range reached) find where the rest ends.

    The rows meet only tables with one line a pattern; just those of the last range (a 16-millionth) are put in order.
    """
    edge1 = _edge(lookup(base, plan, ["pattern"], "inner"), "d1", plan, "rest")
    edge2 = _edge(lookup(base, edge1, ["pattern"], "inner").where("d1 = edge_d1"), "d2", edge1, "left_d1")
    edges = saved(plan.join(edge1, "pattern", "left").join(edge2, "pattern", "left"))
    d = lookup(rows, edges, ["pattern"], "inner")
    last = F.coalesce((F.col("d1") == F.col("edge_d1")) & (F.col("d2") == F.col("edge_d2")), F.lit(False))
    before = F.coalesce((F.col("d1") < F.col("edge_d1")) | ((F.col("d1") == F.col("edge_d1")) & (F.col("d2") < F.col("edge_d2"))), F.lit(False))
    sure = d.where(~last).withColumn("more", F.when(before, F.col("size")).otherwise(0))
    run = W.partitionBy("pattern").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = d.where(last).withColumn("more", F.least("size", F.greatest(F.lit(0).cast("long"), F.col("left_d2") - F.coalesce(F.sum("size").over(run), F.lit(0)))))
    return sure.unionByName(cut).withColumn("taken", (F.col("passes") * F.col("size") + F.col("more")).cast("long"))


def _edge(d: DataFrame, digit: str, limits: DataFrame, left: str) -> DataFrame:
    """For each pattern the hash range in which its running total reaches ``left``, and what is left at the range's start."""
    sums = d.groupBy("pattern", digit).agg(F.sum("size").alias("n"))
    upto = W.partitionBy("pattern").orderBy(digit).rowsBetween(W.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.sum("n").over(upto))
    run = lookup(run, limits.select("pattern", F.col(left).alias("__left")), ["pattern"], "inner")
    hit = run.where("upto >= __left and upto - n < __left and __left > 0")
    return saved(hit.groupBy("pattern").agg(F.min(digit).alias(f"edge_{digit}"), F.min(F.col("__left") - F.col("upto") + F.col("n")).alias(f"left_{digit}")))


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeat_to_weights(docs: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with each row as often as the mix takes it; one that is taken in part stays if half of it is."""
    rows = docs.select(F.struct("doc_id", "source", F.xxhash64("text").alias("th")).alias("id"), F.array("source").alias("sources"), count_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    taken, _ = mix_sources(rows, weights)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    return taken.withColumn("times", times).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def op2_min_cost_flow(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the shares 5, 2, 1 of their sources, in words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = saved(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")))
    # repeated ids stay apart: the id is a struct of what tells rows from each other
    taken, report = mix_sources(rows.select(F.struct("doc_id", "source", "size").alias("id"), F.array("source").alias("sources"), "size"))
    out = lookup(taken, saved(report.select("pattern", "source_size", "target")), ["pattern"])
    return out.select("id.doc_id", "size", "source_size", "target", "taken", "id.source")
