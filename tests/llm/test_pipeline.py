"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import brute
import corpus_pipeline as p
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in p.STAGES:
        out.append(p.saved(f(spark, out[-1], SF)))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "shard", "slot"]


def test_language_keeps_texts(stages):
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    assert all(not any(c.isalpha() for c in before[i]) for i in set(before) - set(after))


def test_near_dedup(stages):
    want = {d for d, v in brute.near(texts(stages[1]), 5, 80).items() if v[2]}
    assert {d for d, _ in texts(stages[2])} == want


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(0, two + " tail"), (1, one), (1, two), (1, three), (1, three), (2, one + " tail"), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(texts(p.near_dedup(spark, docs, SF)))
    assert got == Counter([(0, two + " tail"), (1, one), (1, three), (None, one)])


def test_decontamination(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, v in brute.overlaps(texts(stages[2]), items).items() if v[4]}
    assert {d for d, _ in texts(stages[3])} == {d for d, _ in texts(stages[2])} - bad


def test_mix(stages):
    def by_source(df):
        out = Counter()
        for r in df.collect():
            out[r.source] += len(brute.SPACE_WORD.findall(r.text))
        return out

    from siltloom.llm.mixing import quotas

    size, taken = by_source(stages[3]), by_source(stages[4])
    longest = max(len(t.split()) for _, t in texts(stages[3]))
    for s, goal in quotas(dict(size)).items():
        assert abs(taken[s] - goal) <= longest
    assert max(Counter(d for d, _ in texts(stages[4])).values()) <= 3


def test_shards(stages):
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in stages[4].collect())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_odd_documents(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in p.STAGES:
        docs = p.saved(f(spark, docs, SF))
    assert docs.count() >= 1
    none = odd.select("doc_id", "text", "lang", "source", "n_chars").where("false")
    for _, f in p.STAGES:
        none = p.saved(f(spark, none, SF))
    assert none.count() == 0
