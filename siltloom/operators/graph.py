"""Property graph of code entities: nodes, relation resolution, lookups, k-hop neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltloom.functions.text import entity_id
from siltloom.sources.tables import stored

#: Relation types that a neighbourhood follows.
FOLLOWED = ("EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_FIELD", "CALLS", "INJECTED")
#: Words of 64 seeds each that are searched for together.
WORDS = 8
#: Rows of a neighbourhood that one task makes.
ROWS = 2_000_000
#: Relations and nodes of a name whose edges one task makes at a time; edges of a task, on average.
SOURCES, NODES, EDGES = 2048, 2048, 20_000_000
NODE = ("id", "type", "name", "file_path", "repo", "branch", "language", "start_line", "end_line", "signature", "docstring", "code", "annotations")


def to_nodes(entities: DataFrame) -> DataFrame:
    """Entities with an id and defaults for absent fields; several rows may share an id."""
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c)
    return entities.select(
        entity_id(*map(F.col, ("repo", "branch", "file_path", "type", "name"))).alias("id"), text("type", "Class"), text("name"), text("file_path"), text("repo"), text("branch"), text("language"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), text("signature"), text("docstring"), text("code"), F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations"),
    )


def merge_nodes(entities: DataFrame) -> DataFrame:
    """One node for each id; of several entities the last in the file (start line, then end line) gives all attributes.

    max_by combines before the shuffle, so that only one candidate of each id and task is sent.
    """
    return _last(to_nodes(entities))


def _last(n: DataFrame) -> DataFrame:
    order = F.struct("start_line", "end_line", "code")
    return n.groupBy("id").agg(F.max_by(F.struct(*NODE[1:]), order).alias("n")).select("id", "n.*")


def named_nodes(entities: DataFrame) -> DataFrame:
    """(id, repo, branch, file_path, name) of ``merge_nodes``, stored. Codes are exchanged only for ids that different slices, paths or names share."""
    n, names = to_nodes(entities), ("repo", "branch", "file_path", "name")
    found = stored(n.groupBy("id").agg(F.min(F.struct(*names)).alias("n"), F.max(F.struct(*names)).alias("z")))
    shared = found.where("n <> z").select("id")
    clear = found.where("n = z").select("id", "n.*")
    return clear if shared.isEmpty() else clear.union(stored(_last(n.join(shared, "id", "left_semi")).select("id", *names)))


def relations(entities: DataFrame) -> DataFrame:
    """Relations with a target name: (repo, branch, src_id, rel_type, target_name, target_type, properties)."""
    src = entity_id(*map(F.col, ("repo", "branch", "file_path", "type", "name")))
    flat = entities.select("repo", "branch", src.alias("src_id"), F.explode("relations").alias("r"))
    return flat.where("r.target_name <> ''").select(
        "repo", "branch", "src_id", F.coalesce("r.type", F.lit("CALLS")).alias("rel_type"), "r.target_name", F.coalesce("r.target_type", F.lit("Unknown")).alias("target_type"), "r.properties"
    )


def resolve_edges(entities: DataFrame, nodes: DataFrame, properties: Column | None = None) -> DataFrame:
    """Edges (repo, branch, src_id, rel_type, dst_id, properties): each relation leads to every node of its target's name in its repo and branch.

    One edge for each source, type and destination, with the properties that come first in order; ``properties``: what is taken of them instead. Relations whose name
    no node has go first, the others are made distinct. A name's edges are its relations times its nodes, few bytes in and many rows out, which
    adaptive execution doesn't split: they are dealt to tasks in cells of ``SOURCES`` relations and ``NODES`` nodes, whose ids are one list. Keys begin with a cell's size, so that by the merge join a task
    makes its largest cells first and each of them without a break: the same few ids come again and again, which columnar files hold as numbers of a few bits. A column that has met too many
    values for that is written plainly from there on, so small cells come last. Relations are the side that is streamed: what one row of it makes is held at once.
    """
    name = ["repo", "branch", "target_name"]
    dst = nodes.select("repo", "branch", F.col("name").alias("target_name"), F.col("id").alias("dst_id"))
    sizes = stored(dst.groupBy(*name).agg(F.count("*").alias("n")))
    first = F.to_json("properties")
    r = relations(entities).join(sizes, name).groupBy(*name, "src_id", "rel_type", "n").agg(F.min_by("properties", F.coalesce(first, F.lit(""))).alias("properties"))
    r = stored(r.select(*name, "src_id", "rel_type", "n", (F.col("properties") if properties is None else properties).alias("properties")))
    upto = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    cells = r.groupBy(*name).agg(F.count("*").alias("m"), F.max("n").alias("n")).withColumns({"parts": upto("m", SOURCES), "blocks": upto("n", NODES)})
    cells = stored(cells.withColumns({"cell": F.monotonically_increasing_id(), "after": -F.ceil(F.col("m") / F.col("parts")) * F.ceil(F.col("n") / F.col("blocks"))}))
    total = cells.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    tasks = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // EDGES + 1)
    cells, keys = cells.select(*name, "after", "cell", "parts", "blocks"), ["after", "cell", "part", "block"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = r.drop("n").join(cells, name).withColumn("part", F.pmod(F.xxhash64("src_id", "rel_type"), "parts").cast("int")).withColumn("block", every("blocks"))
    left = left.select(*keys, "src_id", "rel_type", "properties").repartition(tasks, *keys)
    right = dst.join(cells, name).withColumn("block", F.pmod(F.xxhash64("dst_id"), "blocks").cast("int"))
    right = right.groupBy("repo", "branch", "after", "cell", "block", "parts").agg(F.collect_list("dst_id").alias("ids")).withColumn("part", every("parts"))
    both = left.join(right.select(*keys, "repo", "branch", "ids").repartition(tasks, *keys).hint("merge"), keys)
    return both.select("repo", "branch", "src_id", "rel_type", F.explode("ids").alias("dst_id"), "properties")


@dataclass(frozen=True)
class Links:
    """Edges in two parts that meet in groups: ``refs`` (id, rel_type, group) lead from a source to a group, ``members`` (group, id) from there to its nodes.

    A source and each node of its group are an edge. A name with m sources and n nodes takes m + n rows here, not m x n.
    """

    refs: DataFrame
    members: DataFrame

    def without(self, ids: DataFrame) -> Links:
        """The links whose edges touch none of the nodes ``ids`` (id)."""
        gone = ids.select("id").distinct()
        return Links(self.refs.join(gone, "id", "left_anti"), self.members.join(gone, "id", "left_anti"))

    def edge_count(self) -> DataFrame:
        """A row with the number of edges (n_edges): each group's sources times its nodes, added up."""
        n = lambda df, c: df.groupBy("group").agg(F.count("*").alias(c))
        return n(self.refs, "m").join(n(self.members, "n"), "group").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("n_edges"))


def links(entities: DataFrame, nodes: DataFrame) -> Links:
    """The edges of ``resolve_edges`` by target name, not multiplied out: a group is a name in a repo and branch. Relations whose name no node has go before the others are made distinct."""
    group = F.concat_ws("\x01", "repo", "branch", "name")
    members = nodes.select(group.alias("group"), "id")
    refs = relations(entities).withColumnRenamed("target_name", "name").select(F.col("src_id").alias("id"), "rel_type", group.alias("group"))
    refs = stored(refs.join(stored(members.select("group").distinct()), "group", "left_semi").select("id", "rel_type", "group").distinct())
    return Links(refs, members.join(refs.select("group").distinct(), "group", "left_semi"))


def links_of(edges: DataFrame) -> Links:
    """Edges (src_id, rel_type, dst_id) whose groups are their destinations."""
    refs = edges.select(F.col("src_id").alias("id"), "rel_type", F.col("dst_id").alias("group")).distinct()
    return Links(refs, refs.select("group", F.col("group").alias("id")).distinct())


def edges_of(found: Links) -> DataFrame:
    """(src_id, rel_type, dst_id), multiplied out: for a part of the graph that is known to be small."""
    return found.refs.select(F.col("id").alias("src_id"), "rel_type", "group").join(found.members.select("group", F.col("id").alias("dst_id")), "group").select("src_id", "rel_type", "dst_id")


def neighbourhood(seeds: DataFrame, found: Links, depth: int = 2) -> DataFrame:
    """(query_id, seed_id, id, distance): the smallest distance from 1 to ``depth`` (5 at most) of each node that a trail from the seed (query_id, id) reaches,
    over undirected edges of the followed types; the seed's own row is its shortest closed trail. The rows of ``nearest(expand(...))`` by seed.

    Breadth-first, a level at a time. A hop goes from nodes to groups and from groups to nodes; levels and groups are stored, and what was met before is
    dropped, so that the work grows with the nodes reached and the links they have, whatever the number of trails. A node's neighbours are of its own level, the one before or
    the one after: only two levels are looked up. For the closed trails each node carries the smallest and largest first edge of its shortest trails: where
    both differ at level h, two trails meet and close after 2h edges; where an edge joins two nodes of level h with different first edges, after 2h + 1.
    For these a group is met once more one level after it was met first; later levels, whose closed trails would be too long, are a plain search.
    From three levels on, nodes of one edge are told apart first: a trail that reaches one ends there, so that they aren't looked up again.
    Up to two levels all seeds are searched for together (``_together``).
    """
    depth = max(1, min(5, depth))
    if depth < 3:
        return _together(seeds, found, depth)
    refs, members = _with_leaves(stored(found.refs.where(F.col("rel_type").isin(*FOLLOWED))), found.members)
    key = ["query_id", "seed_id"]
    at = seeds.select("query_id", F.col("id").alias("seed_id"), "id").distinct()
    none = F.lit(None).cast("long")
    level = [stored(at.select(*key, "id", F.lit(False).alias("leaf"), none.alias("lo"), none.alias("hi")))]
    groups: list[DataFrame] = []
    closed = None
    reached = None
    firsts = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    for hop in range(1, depth + 1):
        at = level[-1].where("not leaf")
        closing = 2 * hop - 1 <= depth
        down = at.join(refs.drop("leaf"), "id").select(*key, "group", F.lit(True).alias("down"), F.col("rel_type") if hop == 1 else F.lit(None).cast("string").alias("rel_type"), "lo", "hi")
        up = at.join(members.drop("leaf"), "id").select(*key, "group", F.lit(False), F.lit(None).cast("string"), "lo", "hi")
        met = down.union(up).groupBy(*key, "group", "down", "rel_type").agg(*firsts)
        for old in groups[:-1] if closing else groups:
            met = met.join(old.select(*key, "group", "down"), [*key, "group", "down"], "left_anti")
        groups.append(stored(met))
        below = groups[-1].where("down").join(members, "group")
        above = groups[-1].where("not down").drop("rel_type").join(refs, "group")
        if hop == 1:  # an edge's number
            below = below.withColumn("lo", F.xxhash64("seed_id", "rel_type", "id")).withColumn("hi", F.col("lo"))
            above = above.withColumn("lo", F.xxhash64("id", "rel_type", "seed_id")).withColumn("hi", F.col("lo"))
        step = below.select(*key, "id", "leaf", "lo", "hi").union(above.select(*key, "id", "leaf", "lo", "hi"))
        if closing:
            step = step.groupBy(*key, "id", "leaf").agg(*firsts)
            known = [(len(level) - 1 - i, t) for i, t in enumerate(reversed(level[-2:]))]
            table = known[0][1].select(*key, "id", F.lit(known[0][0]).alias("was"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
            for n, t in known[1:]:
                table = table.union(t.select(*key, "id", F.lit(n), "lo", "hi"))
            step = stored(step.join(table, [*key, "id"], "left"))
            new = step.where("was is null and id <> seed_id").select(*key, "id", "leaf", "lo", "hi")
            loops = step.where("id = seed_id").select(*key, F.lit(1).alias("distance")) if hop == 1 else step.where(f"was = {hop - 1} and id <> seed_id and (least(lo, lo0) <> greatest(hi, hi0))").select(*key, F.lit(2 * hop - 1).alias("distance"))
            pairs = new.where("lo <> hi").select(*key, F.lit(2 * hop).alias("distance"))
            closed = loops.union(pairs) if closed is None else closed.union(loops).union(pairs)
        else:
            before = level[-1].select(*key, "id").union(level[-2].select(*key, "id"))
            new = stored(step.where("id <> seed_id").select(*key, "id", "leaf", none.alias("lo"), none.alias("hi")).distinct().join(before, [*key, "id"], "left_anti"))
        level.append(new)
        here = new.select(*key, "id", F.lit(hop).alias("distance"))
        reached = here if reached is None else reached.union(here)
        if hop < depth and new.isEmpty():
            break
    own = closed.groupBy(*key).agg(F.min("distance").alias("distance")).where(F.col("distance") <= depth)
    return reached.union(own.select(*key, F.col("seed_id").alias("id"), "distance"))


def _together(seeds: DataFrame, found: Links, depth: int) -> DataFrame:
    """``neighbourhood`` for one or two levels. Seeds are numbered in order of their ids and taken in blocks of ``WORDS`` words, a bit a seed: what travels from nodes to
    groups and back is one row a node and block, with the bits of the seeds that reach it, so that the work before the result grows with links and blocks of a part of the graph, not with pairs
    of seed and node. Pairs are made last, from bits, without a shuffle.

    A closed trail of two edges goes to a neighbour by one edge and back by another: edges to it are told apart by number (type and direction), and two numbers
    differ in one of their bits.
    """
    words = [f"w{i}" for i in range(WORDS)]
    refs, members = found.refs.where(F.col("rel_type").isin(*FOLLOWED)), stored(found.members)
    groups = stored(members.join(refs.select("group").distinct(), "group", "left_semi").select("group").distinct().withColumn("g", F.monotonically_increasing_id()))
    refs, members = refs.join(groups, "group").select("id", "rel_type", "g"), members.join(groups, "group").select("id", "g")
    refs, members = stored(refs.distinct()), stored(members.distinct())
    ids = stored(refs.select("id").union(members.select("id")).distinct().withColumn("n", F.monotonically_increasing_id()))
    kinds = sorted(r["rel_type"] for r in refs.select("rel_type").distinct().collect())  # those of FOLLOWED at most
    kind = sum((F.when(F.col("rel_type") == k, 2 * i).otherwise(0) for i, k in enumerate(kinds)), F.lit(0))
    refs, members = stored(refs.join(ids, "id").select("n", "g", kind.alias("kind"))), stored(members.join(ids, "id").select("n", "g"))

    asked = seeds.select("query_id", F.col("id").alias("seed_id")).distinct().join(ids.withColumnRenamed("id", "seed_id"), "seed_id")
    asked = asked.repartitionByRange("seed_id", "query_id").sortWithinPartitions("seed_id", "query_id").withColumn("at", F.monotonically_increasing_id())
    asked = stored(asked.withColumn("task", F.shiftright("at", 33)))
    # numbers without gaps, so that few seeds dealt to many tasks don't make a block a task
    before, offsets = 0, []
    for r in asked.groupBy("task").agg(F.count("*").alias("c"), F.min("at").alias("at")).orderBy("task").collect():  # one row a task
        offsets.append((r["task"], before - r["at"]))
        before += r["c"]
    asked = asked.join(F.broadcast(seeds.sparkSession.createDataFrame(offsets, "task long, plus long")), "task").select("query_id", "seed_id", "n", (F.col("at") + F.col("plus")).alias("at"))
    asked = stored(asked.withColumn("block", F.floor(F.col("at") / (64 * WORDS))).withColumn("word", (F.col("at") % (64 * WORDS) / 64).cast("int")).withColumn("bit", (F.col("at") % 64).cast("int")))
    one = F.expr("shiftleft(1L, bit)")
    own = stored(asked.groupBy("n", "block").agg(*[F.bit_or(F.when(F.col("word") == i, one).otherwise(F.lit(0).cast("long"))).alias(f"s{i}") for i in range(WORDS)]))
    none = F.lit(0).cast("long")
    at = lambda c, i: F.coalesce(f"{c}{i}", none)
    without = lambda x, *ys: x if not ys else without(x.bitwiseAND(F.bitwise_not(ys[0])), *ys[1:])
    joined = lambda df, *keys: df.groupBy(*keys).agg(*[F.bit_or(w).alias(w) for w in words])
    some = lambda df, names: df.where(sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in names), F.lit(0)) > 0)

    def hop(now: DataFrame, first: bool) -> DataFrame:
        """(n, block, kind, words): what the nodes of ``now`` reach by one edge; its number where ``first``."""
        down = joined(now.join(refs, "n"), "g", "block", *["kind"] * first).join(members, "g").select("n", "block", F.col("kind") if first else F.lit(0).alias("kind"), *words)
        up = joined(now.join(members, "n"), "g", "block").join(refs, "g").select("n", "block", (F.col("kind") + 1).alias("kind"), *words)
        return down.union(up)

    places = range(max(1, (2 * len(kinds) - 1).bit_length()))
    half = lambda p, v, i: F.bit_or(F.when(F.shiftright("kind", p).bitwiseAND(F.lit(1)) == v, F.col(f"w{i}")).otherwise(none)).alias(f"h{p}_{v}_{i}")
    step = hop(own.select("n", "block", *[F.col(f"s{i}").alias(f"w{i}") for i in range(WORDS)]), True)
    step = step.groupBy("n", "block").agg(*[half(p, v, i) for p in places for v in (0, 1) for i in range(WORDS)]).join(own, ["n", "block"], "left")
    either = lambda i: F.col(f"h0_0_{i}").bitwiseOR(F.col(f"h0_1_{i}"))

    def twice(i: int):
        both = [F.col(f"h{p}_0_{i}").bitwiseAND(F.col(f"h{p}_1_{i}")) for p in places]
        for x in both[1:]:
            both[0] = both[0].bitwiseOR(x)
        return both[0]

    near = stored(
        step.select(
            "n", "block", *[without(either(i), at("s", i)).alias(f"w{i}") for i in range(WORDS)], *[either(i).bitwiseAND(at("s", i)).alias(f"l{i}") for i in range(WORDS)], *[without(twice(i), at("s", i)).alias(f"t{i}") for i in range(WORDS)]
        )
    )
    levels = some(near.select("n", "block", *words, F.lit(1).alias("distance")), words)
    if depth == 2:
        before = near.select("n", "block", *[F.col(f"w{i}").alias(f"v{i}") for i in range(WORDS)])
        far = joined(hop(some(near.select("n", "block", *words), words), False), "n", "block").join(own, ["n", "block"], "left").join(before, ["n", "block"], "left")
        far = stored(far.select("n", "block", *[without(F.col(f"w{i}"), at("s", i), at("v", i)).alias(f"w{i}") for i in range(WORDS)]))
        levels = levels.union(some(far.select("n", "block", *words, F.lit(2).alias("distance")), words))

    closed = near.groupBy("block").agg(*[F.bit_or(f"{c}{i}").alias(f"{c}{i}") for c in "lt" for i in range(WORDS)])
    of = lambda c: F.get(F.array(*[f"{c}{i}" for i in range(WORDS)]), F.col("word")).bitwiseAND(one) != 0
    closed = asked.join(closed, "block").select("query_id", "seed_id", F.col("seed_id").alias("id"), F.when(of("l"), 1).when(of("t"), 2).alias("distance")).where(F.col("distance") <= depth)
    return _pairs(levels, words, asked, ids).union(closed)


def _pairs(levels: DataFrame, words: list[str], asked: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, seed_id, id, distance) of each bit of (n, block, words, distance). The rows are dealt to as many tasks as their pairs need; the seeds of a word are one list."""
    total = levels.agg(F.sum(sum((F.bit_count(w).cast("long") for w in words), F.lit(0)))).first()[0] or 0
    lists = asked.groupBy("block", "word").agg(F.collect_list(F.struct("bit", "query_id", "seed_id")).alias("seeds"))
    rows = levels.join(ids, "n").select("id", "block", "distance", *words).repartition(total // ROWS + 1)
    rows = rows.select("id", "block", "distance", F.posexplode(F.array(*words)).alias("word", "bits")).where("bits <> 0")
    rows = rows.join(F.broadcast(lists) if asked.count() <= 100_000 else lists, ["block", "word"])
    return rows.select("id", "distance", "bits", F.inline("seeds")).where("shiftright(bits, bit) & 1 = 1").select("query_id", "seed_id", "id", "distance")


def _with_leaves(refs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored links with ``leaf``: whether their node has one edge, counted by groups without multiplying them out."""
    count = lambda df: df.groupBy("group").agg(F.count("*").alias("n"))
    ends = refs.join(count(members), "group").select("id", "n").union(members.join(count(refs), "group").select("id", "n"))
    inner = stored(ends.groupBy("id").agg(F.sum("n").alias("n")).where("n > 1").select("id", F.lit(False).alias("more")))
    told = lambda df: stored(df.join(inner, "id", "left").withColumn("leaf", F.coalesce("more", F.lit(True))).drop("more"))
    return told(refs), told(members)


def edge_fanout(entities: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Target names that several nodes of a slice have: how many nodes and how many relations meet there."""
    n = nodes.groupBy("repo", "branch", "name").agg(F.count("*").alias("n_nodes")).where(F.col("n_nodes") >= least)
    r = relations(entities).groupBy("repo", "branch", F.col("target_name").alias("name")).agg(F.countDistinct("src_id", "rel_type").alias("n_relations"))
    return r.join(n, ["repo", "branch", "name"]).select("repo", "branch", "name", "n_nodes", "n_relations")


def in_scope(q: str, d: str) -> Column:
    """Query filters repo and branch, null for any, on a table's own columns."""
    return (F.col(f"{q}.repo").isNull() | (F.col(f"{q}.repo") == F.col(f"{d}.repo"))) & (F.col(f"{q}.branch").isNull() | (F.col(f"{q}.branch") == F.col(f"{d}.branch")))


def lookup_names(names: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Nodes of a name, for (query_id, name, repo?, branch?), ranked by file path and id."""
    q, n = names.alias("q"), nodes.alias("n")
    found = q.join(n, (F.col("q.name") == F.col("n.name")) & in_scope("q", "n")).select("q.query_id", "n.*")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "name").orderBy("file_path", "id")))
    return found if limit is None else found.where(F.col("rank") <= limit)


def lookup_ids(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def entity_with_relations(ids: DataFrame, nodes: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """Nodes with their outgoing relations as an array of (rel_type, target_name, target_type), sorted; empty where there are none.

    With links by name the nodes of a group are counted by name and type, and a relation is repeated by that count in the node's own row only: what is joined and exchanged
    are references and counts, not edges.
    """
    own = lookup_ids(ids, nodes)
    named = nodes.select("id", F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    if isinstance(edges, Links):
        refs = edges.refs.join(ids.select("id").distinct(), "id", "left_semi")
        counts = edges.members.join(named, "id").groupBy("group", "target_name", "target_type").agg(F.count("*").cast("int").alias("n"))
        out = refs.join(counts, "group")
    else:
        out = edges.join(own.select(F.col("id").alias("src_id")), "src_id").join(named.withColumnRenamed("id", "dst_id"), "dst_id").withColumnRenamed("src_id", "id").withColumn("n", F.lit(1))
    out = out.groupBy("id", "rel_type", "target_name", "target_type").agg(F.sum("n").cast("int").alias("n"))
    lists = out.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rel_type", "target_name", "target_type", "n"))).alias("relations"))
    repeated = F.flatten(F.transform("relations", lambda r: F.array_repeat(F.struct(r["rel_type"].alias("rel_type"), r["target_name"].alias("target_name"), r["target_type"].alias("target_type")), r["n"])))
    none = F.array().cast("array<struct<rel_type:string,target_name:string,target_type:string>>")
    return own.join(lists.select("id", repeated.alias("relations")), "id", "left").withColumn("relations", F.coalesce("relations", none))


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` (1 to 5) undirected hops of (query_id, id): (query_id, seed_id, id, name, distance) for every length of a
    trail that reaches them; a trail uses no edge twice, so a self-loop counts as one hop back to the node.

    One equi-join a hop on ids only; names join last. Up to two hops the last edge is all that a trail must remember, so states are few; from three on the
    set of its edges is kept, sorted, and equal states are merged.
    """
    depth = max(1, min(5, depth))
    e = edges.where(F.col("rel_type").isin(*FOLLOWED)).select(F.xxhash64("src_id", "rel_type", "dst_id").alias("e"), "src_id", "dst_id")
    both = e.select("e", F.col("src_id").alias("id"), F.col("dst_id").alias("next")).union(e.where("src_id <> dst_id").select("e", F.col("dst_id").alias("id"), F.col("src_id").alias("next")))
    state = seeds.select("query_id", F.col("id").alias("seed_id"), "id").distinct().withColumn("used", F.array().cast("array<long>"))
    reached = None
    for hop in range(1, depth + 1):
        step = state.join(both, "id").where(~F.array_contains("used", F.col("e")))
        state = step.select("query_id", "seed_id", F.col("next").alias("id"), F.array_sort(F.concat("used", F.array("e"))).alias("used")).distinct()
        here = state.select("query_id", "seed_id", "id", F.lit(hop).alias("distance")).distinct()
        reached = here if reached is None else reached.union(here)
    return reached.join(nodes.select("id", "name"), "id").select("query_id", "seed_id", "id", "name", "distance")


def by_distance(reached: DataFrame) -> DataFrame:
    """Reached nodes of each query, the near ones first, then by name and id; a range sort, so that no query's nodes need fit one task."""
    return reached.orderBy("query_id", "distance", "name", "id")


def nearest(reached: DataFrame) -> DataFrame:
    """The smallest distance of each query and node."""
    return reached.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
