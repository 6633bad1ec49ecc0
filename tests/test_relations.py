"""Relations by name counts give the lists that resolved edges give."""

import random

from pyspark.sql import functions as F

from siltloom.operators import graph as G
from siltloom.operators.entities import RELATION
from siltloom.plans import retrieve as R
from siltloom.sources import tables as T


def test_relations_of_links_are_those_of_edges(spark):
    kinds = ("Class", "Method")
    rows = [("r", "b", f"f{i}", kinds[i % 2], "hot" if i % 3 else f"n{i}", ["hot", "n3", "hot", "none"] if i % 5 == 0 else []) for i in range(60)]
    relation = lambda w: F.struct(F.lit("CALLS").alias("type"), w.alias("target_name"), F.lit("Method").alias("target_type"), F.create_map(F.lit("via"), w).alias("properties"))
    e = spark.createDataFrame(rows, "repo string, branch string, file_path string, type string, name string, words array<string>").withColumn("relations", F.transform("words", relation).cast(RELATION))
    for c, t in (("language", "string"), ("start_line", "int"), ("end_line", "int"), ("signature", "string"), ("docstring", "string"), ("code", "string"), ("annotations", "array<string>")):
        e = e.withColumn(c, F.lit(None).cast(t))
    nodes = G.merge_nodes(e)
    ids = nodes.where("file_path in ('f0', 'f5', 'f7')").select("id")
    of = lambda edges: {r["id"]: r["relations"] for r in G.entity_with_relations(ids, nodes, edges).collect()}
    links, edges = of(G.links(e, nodes)), of(G.resolve_edges(e, nodes))
    assert links == edges and sorted(map(len, links.values())) == [0, 41, 41]


def entities_of(spark, rows):
    """Entities of (repo, branch, file_path, name, start_line, code, words)."""
    relation = lambda w: F.struct(F.lit("CALLS").alias("type"), w.alias("target_name"), F.lit("Method").alias("target_type"), F.create_map(F.lit("via"), w).alias("properties"))
    e = spark.createDataFrame(rows, "repo string, branch string, file_path string, name string, start_line int, code string, words array<string>").withColumn("relations", F.transform("words", relation).cast(RELATION))
    for c in ("language", "signature", "docstring"):
        e = e.withColumn(c, F.lit(None).cast("string"))
    return e.withColumns({"type": F.lit("Class"), "end_line": F.lit(1), "annotations": F.lit(None).cast("array<string>")})


def test_a_hot_names_edges_are_dealt_to_tasks(spark, monkeypatch):
    """150 relations to a name of 120 nodes, which were one task's; a name without nodes and one of a single node besides."""
    for c, n in (("SOURCES", 20), ("NODES", 30), ("EDGES", 1_000)):
        monkeypatch.setattr(G, c, n)
    e = entities_of(spark, [("r", "b", f"f{i}", "hot" if i < 120 else f"n{i}", 1, "", ["hot", "n149", "none"]) for i in range(150)])
    edges = G.resolve_edges(e, G.named_nodes(e), F.col("properties")["via"])
    got = edges.select("src_id", "dst_id", "properties").collect()
    key = lambda i: f"r:b:f{i}:Class:" + ("hot" if i < 120 else f"n{i}")
    assert len(got) == 150 * 121 and {tuple(x) for x in got} == {(key(i), key(j), "hot" if j < 120 else "n149") for i in range(150) for j in (*range(120), 149)}
    tasks = [x["count"] for x in edges.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(tasks) > 10 and max(tasks) < len(got) / 4


def test_nodes_by_name_are_the_merged_ones(spark):
    rows = [("r", "b", "f", "x", 1, "a", []), ("r", "b", "f", "x", 2, "b", []), ("r:b", "c", "f", "y", 3, "late", []), ("r", "b:c", "f", "y", 3, "early", []), ("r", "b", "f", None, 1, "c", [])]
    e = entities_of(spark, rows)
    names = ("id", "repo", "branch", "file_path", "name")
    assert sorted(map(tuple, G.named_nodes(e).select(*names).collect())) == sorted(map(tuple, G.merge_nodes(e).select(*names).collect()))


def test_seeds_are_searched_for_together(spark, monkeypatch):
    """700 seeds call a name of 40 nodes: what is written grows with seeds and nodes, not with their 28,000 pairs, and two blocks of seeds are needed."""
    refs = spark.range(700).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("CALLS").alias("rel_type"), F.lit("hot").alias("group"))
    members = spark.range(40).select(F.lit("hot").alias("group"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    written, kept = [], G.stored

    def counted(df):
        out = kept(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "stored", counted)
    found = G.neighbourhood(refs.select(F.lit(1).alias("query_id"), "id"), G.Links(refs, members), 2)
    assert found.groupBy("distance").count().orderBy("distance").collect() == [(1, 700 * 40), (2, 700 * 699)]
    assert max(written) <= 2 * 740


def test_few_seeds_in_many_tasks_are_one_block(spark, monkeypatch):
    """20 seeds that a session without merging of partitions deals to 16 tasks: each node takes one row, not one a task."""
    refs = spark.range(20).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("CALLS").alias("rel_type"), F.lit("hot").alias("group"))
    members = spark.range(5).select(F.lit("hot").alias("group"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    held, kept = {}, G.stored

    def counted(df):
        out = kept(df)
        if {"block", "w0"} <= set(out.columns):
            held[len(held)] = out.count()
        return out

    monkeypatch.setattr(G, "stored", counted)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = G.neighbourhood(refs.select(F.lit(1).alias("query_id"), "id"), G.Links(refs, members), 2).groupBy("distance").count().orderBy("distance").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(1, 100), (2, 20 * 19)] and max(held.values()) <= 25


def test_a_graph_is_cleared_by_links(spark):
    """Clearing links leaves the edges that clearing resolved ones leaves; a hot name of 80 relations and 60 nodes stays that many rows."""
    slices = spark.createDataFrame([("r0", None), ("r1", "b0")], "repo string, branch string")
    e = entities_of(spark, [(f"r{i % 3}", f"b{i % 2}", f"f{i}", "hot" if i % 4 else f"n{i}", 1, "", ["hot", f"n{i - i % 4}", "none"]) for i in range(360)])
    e = e.union(e.where("file_path in ('f2', 'f8')").withColumn("start_line", F.lit(2)))
    nodes = G.named_nodes(e)
    kept, left, gone = T.clear_graph(nodes, G.links(e, nodes), slices)
    same, edges, deleted = T.clear_graph(G.merge_nodes(e), G.resolve_edges(e, G.merge_nodes(e)), slices)
    want = {tuple(x) for x in edges.select("src_id", "rel_type", "dst_id").collect()}
    assert {tuple(x) for x in G.edges_of(left).collect()} == want and left.edge_count().collect() == [(len(want),)] and len(want) > 5_000
    assert left.refs.count() + left.members.count() < 1_000
    assert {x.id for x in kept.collect()} == {x.id for x in same.collect()} and gone.collect() == deleted.collect() == [(180,)]
    none = left.without(nodes)
    assert none.edge_count().collect() == [(0,)]


def test_edges_of_a_cell_come_together(spark, monkeypatch):
    """Tasks make their largest names first, and a name's edges without a break, so that files hold its few ids as numbers; 40 names of 1 to 40 nodes met at random before."""
    monkeypatch.setattr(G, "EDGES", 10_000)
    e = entities_of(spark, [("r", "b", f"f{i}", f"n{i % 40}", 1, "", [f"n{j}" for j in range(40) if i % 40 >= j and i % (j + 1) == 0]) for i in range(600)])
    edges = G.resolve_edges(e, G.named_nodes(e), F.col("properties")["via"]).withColumn("p", F.spark_partition_id())
    got, seen = edges.collect(), {}
    assert len(got) == sum(15 for i in range(600) for j in range(40) if i % 40 >= j and i % (j + 1) == 0)
    for x in got:
        runs = seen.setdefault(x.p, [])
        if not runs or runs[-1][0] != x.properties:
            runs.append([x.properties, 0])
        runs[-1][1] += 1
    assert max(map(len, seen.values())) > 2
    for runs in seen.values():
        assert len({via for via, _ in runs}) == len(runs) and [n for _, n in runs] == sorted((n for _, n in runs), reverse=True)


def test_far_nodes_are_searched_for_where_they_may_rank(spark, monkeypatch):
    """Queries with enough keys above 0.3 aren't searched for beyond distance 1, with the scores and sources of a search that takes all to distance 2."""
    rng = random.Random(4)
    e = entities_of(spark, [("r", "b", f"f{i}", f"Node{i}", 1, "x", [f"Node{rng.randrange(60)}"]) for i in range(60)])
    nodes = T.stored(G.merge_nodes(e))
    ids = [x.id for x in nodes.orderBy("id").collect()]
    rows = [(q, c, rng.random() if q % 2 else 0.29 * rng.random(), k + 1) for q in range(16) for k, c in enumerate(rng.sample(ids, 3 + q // 4 if q % 4 else 1))]
    top = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")
    queries = spark.createDataFrame([(q, f"explica Node{rng.randrange(60)} y Node{rng.randrange(60)}" if q % 4 else "hola", None, None) for q in range(16)], "query_id long, query string, repo string, branch string")
    chunks = nodes.select(F.col("id").alias("chunk_id"), F.col("id").alias("entity_id"), "repo", "branch", "file_path", F.lit(0).alias("position"))
    asked, search = [], G.neighbourhood

    def noted(seeds, found, depth=2):
        asked.append((depth, seeds.select("query_id").distinct().count()))
        return search(seeds, found, depth)

    links = G.links(e, nodes)
    got = lambda limit: {tuple(x) for x in R.search_hybrid(queries, chunks, nodes, links, limit, top=top).where("rank <= 5").collect()}
    want = got(1000)
    monkeypatch.setattr(R, "neighbourhood", noted)
    assert got(5) == want and len({x[3] for x in want}) == 3
    assert asked[0] == (1, 16) and asked[1][0] == 2 and 0 < asked[1][1] < 16
