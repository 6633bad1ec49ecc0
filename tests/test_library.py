"""Hand-written cases, plain models and properties of the code index."""

import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltloom.functions import paths as P
from siltloom.functions import text as T
from siltloom.operators import chunking as C
from siltloom.operators import graph as G
from siltloom.operators.entities import RELATION, index_chunks, scan_declarations
from siltloom.operators.scopes import docstring_before, scan_source
from siltloom.operators.sqlrefs import inline_sql, references, resolve_sql_refs
from siltloom.operators.vectors import embed, hashed_embedding, validate_vectors, vector_topk
from siltloom.plans import retrieve as R
from siltloom.plans.chat import route_messages
from siltloom.plans.index import index_repos, store
from siltloom.sources import files as S
from siltloom.sources import tables as TB
from siltloom.streaming import events as E


def column(spark, values, f):
    return [r[1] for r in sorted(spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v"))).collect())]


def test_paths(spark):
    names = [".gitignore", ".env", "a..py", "Dockerfile", "vendor/x.py", "package-lock.json", "a/B.JAVA", "x.tar.gz", "src/..py"]
    assert column(spark, names, P.extension) == ["", "", ".py", "", ".py", ".json", ".java", ".gz", ""]
    assert column(spark, names, P.is_supported)[:3] == [False, False, True]
    assert column(spark, names, P.not_ignored)[4:6] == [False, False]
    assert column(spark, ["a/target/b.py", "target.py", "a.cs"], P.in_mirror) == [False, True, False]
    assert column(spark, ["x.jsx", "a.b/c", "README", "q.TS"], P.ast_language) == ["javascript", None, None, "typescript"]
    assert column(spark, ["a/b", "a", "a/b/c", "o-r.g/x_1"], P.is_repo) == [True, False, False, True]


def test_one_chunk_up_to_the_limit():
    assert C.chunk_text("x" * 8000, "text") == [(0, "x" * 8000)]
    assert [p for p, _ in C.chunk_text("x" * 8001, "text")] == [0, 1]


def test_windows_overlap_and_cut_behind_line_feeds():
    text = "".join(f"{i:05d} line\n" for i in range(2000))
    parts = C.by_size(text)
    assert all(t.split("\n")[-1].endswith("line") for _, t in parts[:-1])
    at = 0
    for _, t in parts:
        found = text.index(t, max(0, at - 500))
        assert found <= at
        at = found + len(t)
    assert at >= len(text.rstrip())
    assert [len(t) for _, t in C.by_size("y" * 7700 + "z" * 200 + "w" * 8000)][-1] <= 8000
    assert len(C.by_size("q" * (7600 + 7900))) == 3  # the last window is long, so its overlap follows


@pytest.mark.parametrize("width", [100, 1500, 1590, 7600])
def test_large_block_with_any_header_ends(width):
    lines = ["h" * width] * 5 + ["body " * 20] * 400
    parts = C.blocks(lines, [0])
    assert len(parts) > 1
    assert all(len(t) <= 8000 for _, t in parts)
    assert [p for p, _ in parts] == list(range(len(parts)))


def test_sql_blocks():
    lines = ["select 1;", "select ';", "' || 2;", "-- no; end", "/* a;", "b; */ select 3;", "begin", "x := 1;", "end;", "select 4;", "select 'it\\'s;'", ";"]
    assert C.sql_starts("\n".join(lines), lines) == [0, 3, 6, 9, 10, 12]


def test_json_blocks():
    lines = ['{"a": "}",', '"b": [1,', "2]},", '{"c": "\\"]"}', "]", "[1],"]
    assert C.json_starts("\n".join(lines), lines) == [0, 3, 4]


def test_java_blocks():
    lines = ["package a;", "", "import b;", "@A", "", "// note", "@B", "public class C {", "  int x;", "  @D", "  foo();", "  private int y;", "}"]
    assert C.java_starts(lines) == [0, 2, 3, 11]


def test_blocks_lose_nothing_but_space():
    rng = random.Random(2)
    for language in ("sql", "json", "java", "html", "python", "javascript", "typescript", "csharp", "go", "text"):
        text = "\n".join(rng.choice(["public int a();", "def f(x):", "</div>", "{", "},", "func b()", "select 1;", "class D", "  public void x() {", "word " * 30]) for _ in range(1500))
        assert len(text) > 8000
        joined = "\n".join(t for _, t in C.chunk_text(text, language))
        assert {w for w in text.split()} <= {w for w in joined.split()} | {joined}


def test_line_patterns_run_in_the_jvm(spark):
    d = spark.createDataFrame([("r", "b", "x.go", "\n".join(["func a()", "x" * 5000, "func b()", " func no()", "y" * 5000]))], "repo string, branch string, file_path string, content string")
    found = C.split_by_line_pattern(d, "go")
    assert [(r.position, len(r.text)) for r in sorted(found.collect(), key=lambda r: r.position)] == [(0, 5009), (2, 5020)]
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    same = C.chunk_files(d).select("position", "text").collect()
    assert sorted(map(tuple, same)) == sorted((r.position, r.text) for r in found.collect())


def test_docstring():
    lines = ["code", "/** Says", " * things", " */", "", "@Override", "void f()"]
    assert docstring_before(lines, 6) == "Says\nthings\n"
    assert docstring_before(["x = 1", "def f():"], 1) is None


def entity_names(source, language):
    return [(e["type"], e["name"]) for e in scan_source(source, language)]


def test_scanner():
    py = "class A(Base, m.Mixin, metaclass=M):\n    x = 1\n    def f(self):\n        self.y = g(1)\n        def inner(): pass\n\n@deco(1)\ndef top(a):\n    return A(a)\n"
    assert entity_names(py, "python") == [("Class", "A"), ("Field", "x"), ("Method", "f"), ("Function", "top")]
    a, _, f, top = scan_source(py, "python")
    assert [(r["type"], r["target_name"]) for r in a["relations"]] == [("EXTENDS", "Base"), ("EXTENDS", "Mixin"), ("HAS_FIELD", "x"), ("HAS_METHOD", "f")]
    assert "g" in [r["target_name"] for r in f["relations"]] and top["annotations"] == ["deco"] and (top["start_line"], top["end_line"]) == (8, 9)
    java = "/** Doc */\n@Service\npublic class A<T> extends B implements C, D {\n  private int x, y = 2;\n  public A() { init(); }\n  @Override\n  public List<String> f(int a) {\n    return g(a);\n  }\n}\nenum E { ONE, TWO(2); }\ninterface I { void h(int x); }\n"
    assert entity_names(java, "java")[:5] == [("Class", "A"), ("Field", "x"), ("Field", "y"), ("Method", "A"), ("Method", "f")]
    cls = scan_source(java, "java")[0]
    assert cls["docstring"] == "Doc */" and cls["annotations"] == ["Service"] and cls["end_line"] == 10
    assert {("Enum", "E"), ("Field", "ONE"), ("Field", "TWO"), ("Interface", "I")} <= set(entity_names(java, "java"))
    js = "export class A extends B {\n  run(x) {\n    go(x);\n  }\n}\nfunction f() { return 1; }\nconst g = (a) => {\n  return f();\n};\n"
    assert entity_names(js, "javascript") == [("Class", "A"), ("Method", "run"), ("Function", "f"), ("Function", "g")]
    go = "type A struct {\n  x int\n}\ntype I interface {\n  Run(x int)\n}\nfunc (a A) Run(x int) {\n  f()\n}\nfunc f() {}\n"
    assert entity_names(go, "go") == [("Struct", "A"), ("Interface", "I"), ("Method", "Run"), ("Method", "Run"), ("Function", "f")]


def graph(spark, edges):
    nodes = spark.createDataFrame([(x, x.upper()) for x in sorted({v for e in edges for v in e})], "id string, name string")
    return nodes, spark.createDataFrame([(a, "CALLS", b) for a, b in edges], "src_id string, rel_type string, dst_id string")


@pytest.mark.parametrize("seed", range(3))
def test_trails(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(9)})
    nodes, table = graph(spark, edges)
    want = set()

    def walk(at, used, start):
        if used:
            want.add((start, at, len(used)))
        if len(used) < 3:
            for i, (a, b) in enumerate(edges):
                for nxt in {b} if a == at else set():
                    if i not in used:
                        walk(nxt, used | {i}, start)
                if b == at and a != b and i not in used:
                    walk(a, used | {i}, start)

    seeds = sorted({v for e in edges for v in e})
    for s in seeds:
        walk(s, frozenset(), s)
    found = G.expand(spark.createDataFrame([(1, s) for s in seeds], "query_id int, id string"), nodes, table, 3)
    assert {(r.seed_id, r.id, r.distance) for r in found.collect()} == want
    ordered = [(r.query_id, r.distance, r.name, r.id) for r in G.by_distance(found).collect()]
    assert len(ordered) == len(want) and ordered == sorted(ordered)


@pytest.mark.parametrize("seed", range(4))
def test_neighbourhood_is_the_nearest_of_all_trails(spark, seed):
    """Self-loops, parallel edges of other types and directions, cycles of three to five edges, several seeds a query."""
    rng = random.Random(seed)
    edges = sorted({(rng.choice("abcdefgh"), rng.choice(("CALLS", "EXTENDS", "OTHER")), rng.choice("abcdefgh")) for _ in range(8 + seed)})
    nodes = spark.createDataFrame([(x, x) for x in sorted({v for a, _, b in edges for v in (a, b)})], "id string, name string")
    table = spark.createDataFrame(edges, "src_id string, rel_type string, dst_id string")
    seeds = spark.createDataFrame([(i % 3, x) for i, x in enumerate("abcdefgh")], "query_id int, id string")
    for depth in (1, 2, 5):
        want = G.expand(seeds, nodes, table, depth).groupBy("query_id", "seed_id", "id").agg(F.min("distance").alias("distance"))
        assert {tuple(r) for r in G.neighbourhood(seeds, G.links_of(table), depth).collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_links_are_the_resolved_edges(spark, seed):
    rng = random.Random(seed)
    relation = lambda: {"type": rng.choice(("CALLS", "EXTENDS", "OTHER")), "target_name": rng.choice(("A", "B", "C", "D", "")), "target_type": "Class", "properties": {}}
    rows = [("Class", rng.choice("ABCD"), f"f{i % 7}", f"r{i % 2}", "b", [relation() for _ in range(rng.randrange(3))]) for i in range(12)]
    e = spark.createDataFrame(rows, f"type string, name string, file_path string, repo string, branch string, relations {RELATION}")
    for c in ("language", "signature", "docstring", "code"):
        e = e.withColumn(c, F.lit(""))
    e = e.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "annotations": F.array().cast("array<string>")})
    nodes = G.merge_nodes(e)
    edges, found = G.resolve_edges(e, nodes), G.links(e, nodes)
    assert {tuple(r) for r in G.edges_of(found).collect()} == {tuple(r) for r in edges.select("src_id", "rel_type", "dst_id").collect()}
    seeds = nodes.select(F.lit(1).alias("query_id"), "id")
    want = G.expand(seeds, nodes, edges, 4).groupBy("query_id", "seed_id", "id").agg(F.min("distance").alias("distance"))
    assert {tuple(r) for r in G.neighbourhood(seeds, found, 4).collect()} == {tuple(r) for r in want.collect()}


def test_a_hot_name_costs_sources_plus_nodes(spark):
    """300 sources call a name that 400 nodes have: 120,000 edges are never made."""
    n, sources = 400, 300
    refs = spark.range(sources).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("CALLS").alias("rel_type"), F.lit("hot").alias("group"))
    members = spark.range(n).select(F.lit("hot").alias("group"), F.concat(F.lit("n"), "id").alias("id"))
    found = G.neighbourhood(spark.createDataFrame([(1, "s0")], "query_id int, id string"), G.Links(refs, members), 2)
    assert found.groupBy("distance").count().orderBy("distance").collect() == [(1, n), (2, sources - 1)]  # the shortest closed trail of s0 has four edges


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    v[7] = v[3]
    chunks = spark.createDataFrame([(i, f"r{i % 2}", "b", x.tolist()) for i, x in enumerate(v)] + [(500, "r0", "b", None), (501, "r0", "b", [1.0])], "chunk_id int, repo string, branch string, embedding array<double>")
    q = spark.createDataFrame([(i, v[i].tolist(), "r1" if i % 2 else None) for i in range(6)], "query_id int, vector array<double>, repo string")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(6):
        ok = [j for j in range(200) if i % 2 == 0 or j % 2 == 1]
        want = sorted(ok, key=lambda j: (-round(u[i] @ u[j], 12), j))[:5]
        got = [r.chunk_id for r in vector_topk(q, chunks, 5).where(F.col("query_id") == i).orderBy("rank").collect()]
        assert got == want
    plan = vector_topk(q, chunks, 5)._jdf.queryExecution().toString()
    assert plan.index("MapInArrow") > plan.index("Window")  # vectors stay below the only exchange


@pytest.mark.parametrize("block", [1 << 30, 2000, 1])
def test_topk_with_more_queries_than_a_broadcast(spark, block, tmp_path):
    """Both ways give the same rows, ties, scopes, unlike lengths and nulls included; the chunks are scanned once."""
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 6)).astype(float)  # many ties
    rows = [(i, f"r{i % 3}" if i % 7 else None, "b" if i % 2 else "c", x.tolist()) for i, x in enumerate(v)] + [(900, "r0", "b", None), (901, "r0", "b", [1.0]), (902, "r1", "c", [float(i) for i in range(4)])]
    spark.createDataFrame(rows, "chunk_id int, repo string, branch string, embedding array<float>").write.parquet(f"{tmp_path}/c")
    chunks = spark.read.parquet(f"{tmp_path}/c")
    asked = [(i, v[i].tolist(), f"r{i % 4}" if i % 3 == 0 else None, "b" if i % 5 == 0 else None) for i in range(290)] + [(500, None, None, None), (501, [2.0], None, None), (502, [1.0, 2.0, 0.0, 1.0], None, "c"), (503, [], None, None), (504, [0.0] * 6, None, None)]
    q = spark.createDataFrame(asked, "query_id int, vector array<double>, repo string, branch string")
    want = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in vector_topk(q, chunks, 5).collect())
    blocked = vector_topk(q, chunks, 5, query_bytes=100, block_bytes=block)
    assert sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in blocked.collect()) == want
    assert {r[0] for r in want} == {*range(290), 501, 502, 504} - {i for i in range(290) if i % 3 == 0 and i % 4 == 3}
    for i in (1, 6, 15, 20):
        u = lambda x: x / (np.linalg.norm(x) or 1)
        ok = [j for j in range(300) if (asked[i][2] is None or rows[j][1] == asked[i][2]) and (asked[i][3] is None or rows[j][2] == "b")]
        assert [r[2] for r in want if r[0] == i] == sorted(ok, key=lambda j: (-round(u(v[i]) @ u(v[j]), 12), j))[:5]
    assert vector_topk(q, chunks, 5, query_bytes=100)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_embedding_and_checks(spark):
    d = embed(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "i int, embed_text string"), hashed_embedding(8), 8).collect()
    v = {r.i: r.embedding for r in d}
    assert v[1] == v[2] and len(v[3]) == 8
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (6, [1.0, None])]
    good, bad = validate_vectors(spark.createDataFrame(rows, "i int, embedding array<double>"), 2)
    assert [tuple(r) for r in good.collect()] == [(1, [1.0, 2.0])]
    assert sorted(r.i for r in bad.collect()) == [2, 3, 4, 5, 6]


FILE = "repo string, branch string, file_path string, content string"


def test_sql_inlining(spark):
    java = 'load("q/find.sql"); load("/res.sql"); load("base.sql"); load("none.sql"); load("blank.sql"); load("big.sql"); load("q/find.sql")'
    files = [("r", "b", "src/a/J.java", java), ("r", "b", "src/a/q/find.sql", "FIND"), ("r", "b", "src/main/resources/res.sql", "RES"), ("r", "b", "x/base.sql", "B2"), ("r", "b", "w/base.sql", "B1"), ("r", "b", "blank.sql", " \n"), ("r", "b", "big.sql", "S" * 6001), ("r2", "b", "none.sql", "other repo")]
    f = spark.createDataFrame(files, FILE)
    chunks = f.where("file_path like '%.java'").select("repo", "branch", "file_path", F.lit(0).alias("position"), F.col("content").alias("text"), F.col("content").alias("embed_text"))
    refs = resolve_sql_refs(references(chunks, ["position"]), f, ["position"])
    assert {(r.ref, r.resolved) for r in refs.collect()} == {("q/find.sql", "src/a/q/find.sql"), ("res.sql", "src/main/resources/res.sql"), ("base.sql", "w/base.sql"), ("blank.sql", "blank.sql"), ("big.sql", "big.sql")}
    text = inline_sql(chunks, f, ["position"]).first().text
    part = lambda p, c: f"\n\n-- Referenced SQL: {p} --\n{c}"
    big = "S" * 6000 + "\n-- ... SQL truncado (6001 chars originales) ... --\n"
    assert text == java + part("src/a/q/find.sql", "FIND") + part("src/main/resources/res.sql", "RES") + part("w/base.sql", "B1") + part("big.sql", big) + part("src/a/q/find.sql", "FIND")


def test_slices(spark, tmp_path):
    rows = [("a/b", "x", "f1", 1), ("a/b", "y", "f2", 1), ("c", "x", "f3", 1)]
    d = spark.createDataFrame(rows, "repo string, branch string, file_path string, v int")
    path = str(tmp_path / "t")
    TB.replace_slice(d, path)
    new = d.where("branch = 'x' and repo = 'c'").withColumn("v", F.lit(2))
    TB.replace_slice(new, path, spark.createDataFrame([("c", "x"), ("a/b", "y")], "repo string, branch string"))
    assert sorted((r.repo, r.branch, r.v) for r in spark.read.parquet(path).collect()) == [("a/b", "x", 1), ("c", "x", 2)]
    assert TB.ensure_vectors(spark, str(tmp_path / "v"), 3, "chunk_id string, embedding array<float>")
    assert not TB.ensure_vectors(spark, str(tmp_path / "v"), 3, "chunk_id string, embedding array<float>")
    nodes, edges = graph(spark, [("a", "b"), ("b", "c")])
    old = TB.upsert_edges(edges.withColumn("p", F.lit(1)), edges.limit(1).withColumn("p", F.lit(2)))
    assert old.count() == 2 and old.agg(F.max("p")).first()[0] == 1


def test_index_and_read(spark, tmp_path):
    root = tmp_path / "repos/org/app/main"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_bytes(b"class A(B):\n    def f(self):\n        g()\n# \xff\n")
    (root / "src/b.py").write_text("class B:\n    def g(self):\n        pass\n")
    (root / "notes.md").write_text("hello")
    (root / "empty.md").write_text(" \n")
    files = S.with_text(S.read_files(spark, str(tmp_path / "repos")))
    assert {(r.repo, r.branch, r.file_path) for r in files.collect()} == {("org/app", "main", p) for p in ("src/a.py", "src/b.py", "notes.md", "empty.md")}
    out = index_repos(files, hashed_embedding(8), 8)
    assert out["chunks"].count() == 5 and out["rejects"].count() == 0
    assert {(r.src_id.split(":")[-1], r.rel_type, r.dst_id.split(":")[-1]) for r in out["edges"].collect()} == {("A", "EXTENDS", "B"), ("A", "HAS_METHOD", "f"), ("B", "HAS_METHOD", "g"), ("f", "CALLS", "g")}
    slices = files.select("repo", "branch").distinct()
    for _ in range(2):  # again: the same tables
        store(out, str(tmp_path / "idx"), slices)
        assert spark.read.parquet(str(tmp_path / "idx/chunks")).count() == 5
    assert index_chunks(files, scan_declarations(files.where("false"))).where("file_path like '%.py'").count() == 0


def events():
    push = lambda n, ref: (n, "push", {"ref": ref, "repository": {"full_name": "org/app"}})
    pull = lambda n, action, merged: (n, "pull_request", {"action": action, "pull_request": {"merged": merged, "base": {"ref": "main"}}, "repository": {"full_name": "org/app"}})
    rows = [push("1", "refs/heads/main"), push("2", "refs/tags/v1"), pull("3", "closed", False), pull("4", "closed", True), pull("5", "opened", True), push("1", "refs/heads/main"), push("6", "refs/heads/feature/x"), ("7", "ping", {})]
    return [{"delivery": d, "event": e, "ts": f"2024-01-01T00:{i:02d}:00Z", "payload": json.dumps(p)} for i, (d, e, p) in enumerate(rows)]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.json").write_text("\n".join(map(json.dumps, events())))
    q = E.reindex_triggers(E.dedup_deliveries(S.read_events(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("t").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = sorted(map(tuple, spark.table("t").select("delivery", "repo", "branch", "reason").collect()))
    batch = E.reindex_triggers(E.dedup_deliveries(spark.read.schema(S.EVENT).json(str(tmp_path / "in"))))
    assert streamed == sorted(map(tuple, batch.select("delivery", "repo", "branch", "reason").collect())) == [("1", "org/app", "main", "push"), ("4", "org/app", "main", "merge"), ("6", "org/app", "feature/x", "push")]
    files = spark.createDataFrame([("org/app", "main", "a.py", "class A:\n    pass\n"), ("org/app", "other", "b.py", "class B:\n    pass\n")], FILE)
    E.refresh(S.read_events(spark, str(tmp_path / "in")), lambda: files, str(tmp_path / "idx"), hashed_embedding(4), 4, str(tmp_path / "cp")).awaitTermination(180)
    assert [(r.branch, r.ast_name) for r in spark.read.parquet(str(tmp_path / "idx/chunks")).collect()] == [("main", "A")]


def test_runs_after_a_quiet_time(spark, tmp_path):
    """A slice's triggers are one run once its quiet time is over, in the stream as in the batch; the stream indexes each run once, into snapshots."""
    from siltloom.plans.index import publish
    from siltloom.sources.snapshots import Snapshots

    push = lambda n, ts, branch="main": {"delivery": n, "event": "push", "ts": f"2024-01-01T{ts}:00Z", "payload": json.dumps({"ref": f"refs/heads/{branch}", "repository": {"full_name": "org/app"}})}
    said = [push("1", "00:00"), push("2", "00:07"), push("2", "00:07"), push("3", "00:16"), push("4", "00:10", "dev"), push("5", "00:40"), push("6", "09:00"), push("7", "18:00", "dev")]
    (tmp_path / "in").mkdir()
    for i, e in enumerate(said):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(e))
    batch = E.quiet_runs(E.reindex_triggers(E.dedup_deliveries(spark.read.schema(S.EVENT).json(str(tmp_path / "in")))))
    runs = sorted((r.branch, r.first_ts.hour * 60 + r.first_ts.minute, r.last_ts.hour * 60 + r.last_ts.minute, r.n_triggers) for r in batch.collect())
    assert runs == [("dev", 10, 10, 1), ("dev", 1080, 1080, 1), ("main", 0, 16, 3), ("main", 40, 40, 1), ("main", 540, 540, 1)]
    seen = []

    def save(out, root, slices):
        seen.append(sorted(r.branch for r in slices.collect()))
        publish(out, root, slices, 4)

    stream = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 8).json(str(tmp_path / "in"))
    files = spark.createDataFrame([("org/app", "main", "a.py", "class A:\n    pass\n"), ("org/app", "other", "b.py", "class B:\n    pass\n")], FILE)
    E.refresh(stream, lambda: files, str(tmp_path / "idx"), hashed_embedding(4), 4, str(tmp_path / "cp"), quiet="10 minutes", save=save).awaitTermination(240)
    assert [r.ast_name for r in Snapshots(spark, str(tmp_path / "idx")).read("chunks").collect()] == ["A"]
    assert {b for x in seen for b in x} == {"dev", "main"} and len(seen) == 1  # all runs that the watermark has passed, in one batch; the last one waits for its quiet time


def test_messages(spark):
    said = ["indexa org/r dev", "reindexa org/r", "generame un pdf", "guardar como md", "grafo Foo", " repos ", "explica org/web/my-mod rama dev", "indexa "]
    d = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)] + [(50, 0, "user", '[{"type": "text", "text": "repos"}]'), (51, 0, "assistant", "x"), (52, 0, "user", "  ")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in route_messages(d).collect()}
    assert [got[i].intent for i in range(8)] == ["index", "index", "pdf", "markdown", "graph", "repos", "question", "question"]
    assert (got[0].repo, got[0].branch, got[1].branch) == ("org/r", "dev", "HEAD")
    assert (got[6].repo, got[6].branch) == ("org/web", "dev") and got[6].question.split(" dev ")[1].startswith("my mod Java class")
    assert got[4].class_name == "Foo" and got[50].intent == "repos" and not {51, 52} & set(got)


def test_keywords(spark):
    words = column(spark, ["El ConsultarServiceImpl usa Foo y Dao; mostrando tablas cuando hay inventarios"], lambda c: F.array_join(T.keywords(c), ","))
    assert words == ["ConsultarServiceImpl,Foo,Dao,tablas,inventarios"]
    assert column(spark, ["see OrderServiceImpl and UserDao, Plain"], lambda c: F.array_join(T.class_names(c), ",")) == ["OrderServiceImpl,UserDao"]
    asked = "explica OrderModel y PaymentStrategy y UserGateway2 y Reporte y ABImpl y iPhone"
    assert column(spark, [asked], lambda c: F.array_join(T.class_names(c, 9), ",")) == ["OrderModel,PaymentStrategy,UserGateway2,ABImpl"]
    assert column(spark, [asked], lambda c: F.array_join(T.class_names(c, 9, ["Model"]), ",")) == ["OrderModel"]


def test_chunks_of_one_file_keep_order():
    rows = [C.chunk_text("\n".join(["func a() {", "x" * 9000, "}"] * 2), "go")]
    assert all(a[0] < b[0] for r in rows for a, b in itertools.pairwise(r))


def test_answer_context_has_all_stages(spark):
    """One question with a known class, its relation, a class that only stands in a path, and a word that only a file holds."""
    relation = "array<struct<type:string,target_name:string,target_type:string,properties:map<string,string>>>"
    calls = [{"type": "CALLS", "target_name": "pagar", "target_type": "Method", "properties": {}}]
    rows = [("Class", "PedidoDao", "src/P.java", "class PedidoDao { pagar(); }", calls), ("Method", "pagar", "src/Q.java", "void pagar() { }", []), ("Class", "OtraDao", "src/O.java", "class OtraDao { }", [])]
    schema = f"type string, name string, file_path string, code string, relations {relation}"
    e = spark.createDataFrame(rows, schema).selectExpr(
        "type", "name", "file_path", "'org/a' as repo", "'main' as branch", "'java' as language", "1 as start_line", "2 as end_line", "cast(null as string) as signature", "cast(null as string) as docstring", "code",
        "cast(array() as array<string>) as annotations", "relations",
    )
    nodes = G.merge_nodes(e)
    contents = [("src/P.java", "class PedidoDao { pagar(); }"), ("src/FaltaScheduler.java", "class FaltaScheduler { }"), ("src/z.py", "# Factura de todos"), ("src/no.py", "# nada")]
    files = spark.createDataFrame([("org/a", "main", *c) for c in contents] + [("org/b", "main", "src/z.py", "# Factura ajena")], "repo string, branch string, file_path string, content string")
    vector = [0.0] * 3 + [1.0]
    chunk = nodes.selectExpr("sha1(id) as chunk_id", "id as entity_id", "repo", "branch", "file_path", "language", "0 as position", "code as text", "type as ast_type", "name as ast_name", "signature as ast_signature")
    paths = spark.createDataFrame([("f", None, "org/a", "main", "src/FaltaScheduler.java", "java", 0, "", None, None, None)], ", ".join(f"{c} {t}" for c, t in chunk.dtypes))
    chunks = chunk.union(paths).withColumn("embedding", F.array(*[F.lit(x).cast("float") for x in (1.0, 0.0, 0.0, 0.0)]))
    q = spark.createDataFrame([(1, "explica PedidoDao y FaltaScheduler y Factura de org/a rama main", vector), (2, "hola", vector)], "query_id long, query string, vector array<float>")
    got = {r.query_id: r.context for r in R.answer_context(q, chunks, nodes, G.resolve_edges(e, nodes), files).collect()}
    parts = got[1].split("\n\n---\n\n")
    assert [p.split("]")[0] for p in parts] == [f"[Fragmento {i + 1}" for i in range(len(parts))]
    found = [(re.search(r"Source: (\S+)", p)[1], re.search(r"Archivo: (\S+)", p)[1]) for p in parts]
    of = {path: source.split("+") for source, path in found}
    assert "entity" in of["src/P.java"] and "relation" in of["src/Q.java"] and "fetch" in of["src/FaltaScheduler.java"] and of["src/z.py"] == ["clone"], found
    assert "src/no.py" not in of and "ajena" not in got[1]
    assert len(found) == len(set(found))


@pytest.mark.parametrize("seed", range(3))
def test_postings_find_what_holds_a_pattern(spark, seed):
    from siltloom.operators.postings import holding, post

    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé𝒳 ") for _ in range(n))
    rows = [(f"r{i % 2}", i, word(rng.randrange(0, 60))) for i in range(60)] + [("r0", 100, None), ("r0", 101, "")]
    asked = {(f"r{rng.randrange(3)}", word(rng.randrange(0, 6))) for _ in range(60)} | {("r0", "zzz"), ("r1", None)}
    texts = spark.createDataFrame(rows, "repo string, doc int, text string")
    got = holding(spark.createDataFrame(sorted(asked, key=repr), "repo string, pattern string"), post(texts, ("repo",)), texts)
    assert sorted(map(tuple, got.collect())) == sorted((r, p, d) for r, p in asked if p for own, d, t in rows if own == r and t and p in t)


def test_leaves_end_a_trail(spark, monkeypatch):
    """Nodes of one edge are reached, but not looked up: a level of them leads to no group and no further level."""
    table = spark.createDataFrame([(f"o{i}", "CALLS", f"c{i % 5}") for i in range(200)] + [(f"c{i}", "CALLS", "n") for i in range(5)], "src_id string, rel_type string, dst_id string")
    nodes = table.selectExpr("src_id as id").union(table.select("dst_id")).distinct().withColumn("name", F.col("id"))
    seeds = spark.createDataFrame([(1, "n")], "query_id int, id string")
    sizes, kept = [], G.stored

    def counted(df):
        out = kept(df)
        sizes.append(("down" in out.columns, out.count()))
        return out

    monkeypatch.setattr(G, "stored", counted)
    got = G.neighbourhood(seeds, G.links_of(table), 4).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in G.expand(seeds, nodes, table, 2).groupBy("query_id", "seed_id", "id").agg(F.min("distance")).collect()}
    assert [n for groups, n in sizes if groups] == [1, 6, 0]


def test_postings_are_lists(spark):
    """A trigram takes a row for each slice of texts, not for each text, with each text that holds it once."""
    from siltloom.operators.postings import post

    rows = [("r0", i, "ababab") for i in range(50)] + [("r1", 50, "abax"), ("r1", 51, "ab")]
    index = post(spark.createDataFrame(rows, "repo string, doc int, text string").coalesce(1), ("repo",))
    got = {(r.repo, r.gram): sorted(r.docs) for r in index.lists.collect()}
    assert got == {("r0", "aba"): list(range(50)), ("r0", "bab"): list(range(50)), ("r1", "aba"): [50], ("r1", "bax"): [50]} and index.lists.count() == 4
    assert {(r.repo, r.gram): r.n for r in index.sizes.collect()} == {k: len(v) for k, v in got.items()}
