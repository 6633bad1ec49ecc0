"""The fusion of evidence against a plain version, and cases that the operators must stand."""

import re
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltloom.llm import common
from siltloom.llm.decontamination import find_overlaps
from siltloom.llm.language import Fusion, identify, keep_identified, labelled, train
from siltloom.llm.minhash import near_duplicates
from siltloom.llm.pivots import Index, choose_pivots, link_vectors
from siltloom.llm.sharding import shard_by_bytes
from siltloom.llm.substrings import dedup_substrings

SF = "/root/testdata/sf0.001"


def test_fusion_equals_the_plain_version(spark, docs):
    model, fusion = train(labelled(docs)), Fusion()
    hosts = [None, "a.example.de", "b.example.de", "news.site.fr", "x.org"]
    rows = [(r.doc_id, r.text[: 40 + r.doc_id % 60], hosts[r.doc_id % 5], None if r.doc_id % 5 == 0 else hosts[r.doc_id % 5].split(".")[-1], [None, r.lang, "xx"][r.doc_id % 3]) for r in docs.limit(120).collect()]
    rows += [(-1, None, "x.org", "org", "en"), (-2, "", None, None, None), (-3, "ok", "a.example.de", "de", None)]
    d = spark.createDataFrame(rows, "id long, text string, host string, suffix string, declared string")
    want = brute.fused(rows, model, fusion)
    for r in identify(d, model, False, fusion).collect():
        assert r.lang == want[r.id][0] or abs(want[r.id][1] - 0.5) < 1e-3
        assert r.posterior == pytest.approx(want[r.id][1], abs=2e-5)


def test_documents_without_labels_stay(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert keep_identified(bare).count() == docs.count()


def test_many_languages_share_buckets(docs):
    model = train(labelled(docs), Fusion(cells=4 * 512))
    assert model.table.shape == (512, len(model.languages))


@pytest.mark.parametrize("half", [None, 7])
def test_sharding_parts_rows_that_are_alike(spark, half):
    rows = [(half, "the same text in half of all rows") for _ in range(3000)] + [(i, f"another text {i} of about that size") for i in range(3000)]
    size, slots = Counter(), Counter()
    for r in shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect():
        size[r.shard] += len(r.text) + 1
        slots[r.shard] = max(slots[r.shard], r.slot + 1)
    mean = sum(size.values()) / 8
    assert all(abs(size[s] - mean) <= 0.02 * mean for s in range(8))
    assert sum(slots.values()) == len(rows)


def test_ids_that_are_texts(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    name = {i: f"{i:05d}" for i, _ in rows}
    d = spark.createDataFrame([(name[i], t) for i, t in rows], "doc_id string, text string")
    assert {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(d).collect()} == {name[i]: (n, name[c], k) for i, (n, c, k) in brute.near(rows).items()}
    assert {r[0]: tuple(r[1:]) for r in dedup_substrings(d).collect()} == {name[i]: v for i, v in brute.repeats(rows).items()}
    bench = spark.createDataFrame([("x2", " ".join(rows[0][1].split()[:30])), ("x10", rows[1][1])], "item_id string, text string")
    found = {r.doc_id: r["items"] for r in find_overlaps(d, bench).collect()}
    assert "x2" in found[name[rows[0][0]]] and "x10" in found[name[rows[1][0]]]


def test_labels_that_are_texts(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [1.0, 0.0]), (4, None, [1.0, 0.0])]
    got = {r[0]: tuple(r[1:3]) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_byte_settings():
    assert [common.byte_count(x) for x in ("8388608b", "8m", "64MB", "1KiB", "12", "-1")] == [8 << 20, 8 << 20, 64 << 20, 1024, 12, -1]


def test_saved_tables_can_be_dropped(spark):
    kept = common.saved(spark.range(3))
    assert kept.count() == 3
    path = kept.inputFiles()[0]
    common.drop_saved(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_vectors_of_two_lengths(spark):
    """Each length has pivots of its own, so that the rarer one isn't compared all against all; links are those of brute force."""
    rnd = np.random.default_rng(4)
    rows = []
    for dim, n in ((24, 500), (16, 400), (1, 3), (7, 1)):
        x = rnd.normal(size=(n, dim))
        if n > 10:
            x[n // 2 :] = x[: n // 2] + rnd.normal(size=(n // 2, dim)) * 0.1
        rows += [(len(rows) + i, 1, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {r[0]: tuple(r[1:]) for r in link_vectors(d).collect()} == brute.linked_vectors(rows)
    reps = spark.createDataFrame([(i, len(v), np.array(v).tobytes()) for i, _, v in rows], "rep long, dim int, v binary")
    pivots = choose_pivots(reps, Index())
    assert set(pivots) == {24, 16, 1, 7}
    assert all(len(pivots[d]) > 30 and pivots[d].shape[1] == d for d in (24, 16))
    assert set(choose_pivots(reps, Index(most_pivots=16, least_pivots=64))) == {24}
    assert choose_pivots(reps.limit(0), Index()) == {}


def test_empty_bins_beside_the_largest_hashes(spark):
    """A minimum at the end of the int's range is taken for empty bins without leaving it."""
    from siltloom.llm.lines import Fuzzy, _banded

    fuzzy = Fuzzy()
    values = ", ".join([f"cast({2**31 - 1} as int) as m0"] + [f"cast(null as int) as m{i}" for i in range(1, fuzzy.bins)])
    row = _banded(spark.sql(f"select 1L as h1, 2L as h2, 1L as times, 0 as most, {values}"), fuzzy).first()
    assert len(row.bands) == fuzzy.bands and not row.poor


def test_links_of_vectors_with_text_ids(spark):
    from siltloom.llm.pivots import link_vectors

    rng = np.random.default_rng(2)
    one = rng.normal(size=8)
    rows = [(10 + i, 1, (one + 0.01 * rng.normal(size=8)).tolist()) for i in range(5)] + [(30 + i, 1, rng.normal(size=8).tolist()) for i in range(5)] + [(None, 1, one.tolist()), (50, None, one.tolist()), (51, 1, None)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    named = table.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    text = lambda i: None if i is None else f"v{i}"
    want = sorted(((text(r.vec_id), r.n_links, text(r.component_id), r.kept) for r in link_vectors(table).collect()), key=repr)
    assert sorted(map(tuple, link_vectors(named).collect()), key=repr) == want


def test_mix_keeps_columns_with_names_of_its_own(spark):
    from siltloom.llm.mixing import mix_sources

    rows = [(i, [f"s{i % 3}"], 10 + i, "keep", i, "more", 1.5) for i in range(30)]
    t = spark.createDataFrame(rows, "id long, sources array<string>, size long, h string, d1 long, more string, left_d1 double")
    taken, _ = mix_sources(t)
    plain, _ = mix_sources(t.select("id", "sources", "size"))
    got = {r.id: r for r in taken.collect()}
    assert all((r.h, r.d1, r.more, r.left_d1) == ("keep", r.id, "more", 1.5) for r in got.values())
    assert {i: r.taken for i, r in got.items()} == {r.id: r.taken for r in plain.collect()}


def test_decontamination_stage_keeps_all_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame([(1, "a clean text", 7, "x", [1]), (2, " ".join(f"b{i}" for i in range(20)), 8, "y", [2])], "doc_id long, text string, n_words int, hits string, items array<int>")
    assert [tuple(r) for r in corpus_pipeline.decontaminate(spark, d, str(tmp_path)).collect()] == [(1, "a clean text", 7, "x", [1])]


def test_targets_of_the_mix_against_a_plain_version(spark):
    """Shares 5, 2, 1 by turns in order of the sources' names, null last; what exceeds three times a source's size goes to the others by weight."""
    from siltloom.llm.mixing import op2_min_cost_flow

    rows = op2_min_cost_flow(spark, SF).collect()
    sizes = {r.source: r.source_size for r in rows}
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    assert {s: sum(r.size for r in rows if r.source == s) for s in names} == sizes
    target, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
    assert {r.source: pytest.approx(r.target, rel=1e-9) for r in rows} == target
    for s in names:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 1


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components_join_all_edges_once(spark, monkeypatch, kind):
    """Roots are those of a union-find, and what is written stays near the edges: inner edges of a tree aren't looked up again."""
    import random

    from siltloom.llm import common

    rng = random.Random(5)
    edges = {"random": [(rng.randrange(400), rng.randrange(400)) for _ in range(2000)], "path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 300)], "none": []}[kind]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    joined, join = [], type(spark.range(1)).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        joined.append(out)
        return out

    df = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(type(df), "join", counted)
    got = {r.v: r.root for r in common.components(df).collect()}
    monkeypatch.undo()
    assert got == {v: find(v) for v in {v for e in edges if e[0] != e[1] for v in e}}
    if kind == "random":
        assert sum(x.count() for x in joined) <= 2 * len(edges) + 8 * len(got)


def test_lines_minima_by_filters(spark):
    """A shingle's row touches the minimum of its own bin only, and a text is hashed once, not once a line."""
    from siltloom.llm.lines import Fuzzy, _minima, lines_of

    fuzzy = Fuzzy()
    docs = spark.createDataFrame([(1, "one line of some length\nanother line of some length")], "doc_id long, text string")
    plan = _minima(lines_of(docs, "doc_id", "text"), fuzzy, True)._jdf.queryExecution().optimizedPlan().toString()  # shows 25 columns at most
    assert "CASE WHEN (bin" not in plan and len(re.findall(r"min\(value#\d+\) FILTER \(WHERE \(bin#\d+ = \d+\)\)", plan)) > 20
    plan = lines_of(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")


def test_lines_that_met_before_are_not_compared_again(spark):
    """Of a row's lines only those that share it with one they haven't met in an earlier band are compared."""
    from siltloom.llm.lines import Fuzzy, linked

    line = "a line of some length that others are copies of "
    member = "struct<id:long,root:long,met:long,bands:array<long>,line:string>"
    high = [(i, i, i, [1 if i < 2 else i, 9], line + str(i)) for i in range(3)]
    rows = spark.createDataFrame([(1, [], high), (1, [], high[:2])], f"band int, low array<{member}>, high array<{member}>")
    assert sorted(map(tuple, linked(rows, Fuzzy()).collect())) == [(1, 0), (2, 0)]
    one = rows.where("size(high) = 2")
    assert linked(one, Fuzzy()).collect() == []
