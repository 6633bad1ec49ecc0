"""Context mixing, whitening and clustering against plain versions of their contracts, and on odd input."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltloom.llm.centroids import Clusters, Lists, cluster_vectors, op13_threshold_algorithm
from siltloom.llm.context_mixing import Mixing, op11_context_mixing, score_texts, states_of
from siltloom.llm.whitening import Whitening, exact_products, leading_eigenvalues, leading_pairs, op12_householder_whitening, sturm_counts, tridiagonal, whiten

SF = "/root/testdata/sf0.001"
SMALL = Mixing(words=300, word_slots=16, char_slots=16, share=2)


# op11


def plain_base(rows):
    """(doc_id, text) rows to the contract's columns, by counting."""
    words = [(t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split() for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    return n, [(i, h, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None])) for (i, _), ws, h in zip(rows, words, held)]


def test_scores_follow_the_contract(spark, docs):
    n, want = plain_base([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in op11_context_mixing(spark, SF).collect()}
    assert len(got) == len(want)
    for i, held, tokens, known, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0 and abs(r.bits_per_byte + r.score * math.log2(10) / (len(docs.where(F.col("doc_id") == i).first().text.encode()) + 1)) < 1e-9 if i < 5 else True


def test_contexts_help_on_held_out_texts(spark):
    """Sentences of a small grammar: the word before tells the next one, which counts of single words can't know."""
    rng = np.random.default_rng(3)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}" for i in range(40)]
    rows = [(i, " ".join(f"{nouns[k]} {verbs[k]} {nouns[(k + 1) % 40]}." for k in rng.integers(0, 40, 30))) for i in range(400)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.75 * got[1]  # less than three quarters of the digits


def test_probabilities_of_all_next_words_add_up(spark):
    """The model is a distribution: over all words of a closed set, spelled or coded, and the end, probabilities after one start sum to less than 1."""
    rows = [(i, "a b") for i in range(20)] + [(100 + i, w) for i, w in enumerate(["", "a", "b", "c", "d", "aa", "ab"])]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    p = sum(10**r.score for r in got.where("doc_id >= 100").collect()) + 10 ** got.where("doc_id = 0").first().score
    assert 0 < p <= 1 + 1e-6


def test_a_score_depends_on_the_text_alone(spark, docs):
    few = docs.select("doc_id", "text").limit(60)
    got = {r.doc_id: r.score for r in score_texts(few, SMALL).collect()}
    other = {r.doc_id: r.score for r in score_texts(few.repartition(7).withColumn("more", F.lit(1)), SMALL).collect()}
    assert got.keys() == other.keys()
    assert all(abs(got[i] - other[i]) < 1e-6 * abs(got[i]) for i in got)


def test_scores_of_odd_rows(spark, odd):
    rows = odd.withColumn("doc_id", F.col("doc_id"))
    n, want = plain_base([(r.doc_id, r.text) for r in rows.collect()])
    got = score_texts(rows, SMALL).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for r, w in zip(sorted([tuple(r) for r in got], key=key), sorted(want, key=key)):
        assert r[:4] == w[:4] and r[4] == n and abs(r[5] - w[4]) < 1e-6 * max(1, abs(w[4]))
    assert len({r.score for r in got if r.doc_id == 8}) == 1  # repeated rows score alike
    assert score_texts(rows.where("false"), SMALL).collect() == []


def test_without_training_rows(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = score_texts(spark.createDataFrame([(i, "x y")], "doc_id long, text string"), SMALL).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0


@pytest.mark.parametrize("kind", ["binary", "large_binary"])
def test_words_are_split_as_bytes(kind):
    import pyarrow as pa

    from siltloom.llm.context_mixing import tokens_of

    texts = [b"", None, b" \t a\x1cB\x0bc\xffD \x85\xc2\xa0e\n\n", b"\x00 Z", "Ünï ÀB".encode(), b"   "]
    want = [(i, w) for i, t in enumerate(texts) for w in (t or b"").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
    for rows in (texts, texts[:2], []):
        words, of = tokens_of(pa.array(rows, getattr(pa, kind)()))
        assert list(zip(of.tolist(), words.to_pylist())) == [x for x in want if x[0] < len(rows)]
    words, of = tokens_of(pa.array([b"x y", *texts], getattr(pa, kind)()).slice(1))
    assert list(zip(of.tolist(), words.to_pylist())) == want


def test_all_training_rows_teach(spark, docs, monkeypatch):
    """Weights and map are learned from each training text and each word without a code; what states are worth from each bit, as one pass over all bits finds it."""
    from siltloom.llm import context_mixing as cm

    taught, learn = [], cm.learn

    def seen(mixer, *args):
        df, column, parts = next((args[i : i + 3] for i, x in enumerate(args) if hasattr(x, "sparkSession")))
        want = np.zeros((len(mixer.tables), 512))
        for batch in df.select(column).toArrow().to_batches():
            for b in parts(batch):
                for n, s in zip(want, mixer.inputs(b, True)[0]):
                    n += np.bincount(s * 2 + b.bit, minlength=512)
        taught.append((df.count(), np.array_equal(args[0].reshape(len(want), 512), want)))
        return learn(mixer, *args)

    monkeypatch.setattr(cm, "learn", seen)
    rows = docs.select("doc_id", "text").limit(80)
    score_texts(rows, Mixing(words=300, word_slots=16, char_slots=16)).count()
    training = [(r.text or "").encode().lower().split() for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    assert taught == [(len(training), True), (len({w for t in training for w in t}) - 300, True)]


def test_levels():
    assert states_of(np.array([0, 1, 4, 5, 65535]), np.array([0, 0, 1, 2, 3])).tolist() == [0, 16, 65, 82, 15 * 16 + 3]


# op12


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenpairs(n):
    a = np.random.default_rng(n).normal(size=(n, n))
    a = a @ a.T
    k = min(n, 32)
    values, v = leading_pairs(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-13 and np.abs(a @ v - v * values).max() < 1e-12 * values[0]


@pytest.mark.parametrize("a", [np.eye(40), np.diag([1.0] * 20 + [2.0] * 20), np.ones((40, 40)) + np.eye(40), np.kron(np.eye(4), np.ones((10, 10))), np.zeros((5, 5)), np.diag([1, 1 - 1e-13, 1 - 2e-13, 0.5])])
def test_equal_and_near_eigenvalues(a):
    k = min(len(a), 32)
    values, v = leading_pairs(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * max(1, values[0]))
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12 and np.abs(a @ v - v * values).max() < 1e-11 * max(1, values[0])


def test_sturm_counts():
    a = np.diag([1.0, 2.0, 3.0, 4.0]) + np.diag([0.5] * 3, 1) + np.diag([0.5] * 3, -1)
    w = np.linalg.eigvalsh(a)
    assert sturm_counts(np.diag(a).copy(), np.diag(a, 1).copy(), np.r_[w - 1e-9, w + 1e-9]).tolist() == [0, 1, 2, 3, 1, 2, 3, 4]
    d, e, _ = tridiagonal(a)
    assert np.allclose(leading_eigenvalues(d, e, 4), w[::-1])


def test_exact_products():
    y = np.random.default_rng(1).integers(-(1 << 41), 1 << 41, (5000, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
    assert exact_products(y).tolist() == want


def test_whitening_follows_the_contract(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in e], np.int64)
    n, s = len(x), x.sum(0)
    centred = x - s / n
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:32], q[:, ::-1][:, :32]
    w = centred @ q / np.sqrt(values)
    at = {r.vec_id: i for i, r in enumerate(e)}
    rows = op12_householder_whitening(spark, SF).collect()
    assert len(rows) == 32 * n and {r.component for r in rows} == set(range(1, 33))
    signs = {}
    for r in rows:
        i, j = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == int(((n * x[i] - s) ** 2).sum()) and abs(r.explained - values[j] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9
        signs.setdefault(j, math.copysign(1, r.whitened * w[i, j]) if abs(w[i, j]) > 1e-3 else 0)
    for r in rows:
        j = r.component - 1
        if signs[j]:
            assert abs(signs[j] * r.whitened - w[at[r.vec_id], j]) < 1e-6


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), "x", 1.0) for i in range(30)]
    rows += [(30, None, "x", 1.0), (31, [1.0, None, 2.0], "x", 1.0), (32, [float("nan"), 1.0, 1.0], "x", 1.0), (33, [float("inf"), 1.0, 1.0], "x", 1.0), (34, [], "x", 1.0), (35, [1.0, 2.0], "x", 1.0), (None, [0.5, 0.5, 0.5], "x", 1.0), (0, rows[0][1], "x", 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, w string, deviation double")
    got = whiten(table).collect()
    assert len(got) == 3 * 32 and {r.n for r in got} == {32} and sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 0 for r in got) == 6
    w = np.array([[r.whitened for r in got if r.component == c] for c in (1, 2, 3)])
    assert np.abs(w @ w.T / 32 - np.eye(3)).max() < 1e-9
    assert whiten(table.where("false")).collect() == [] and whiten(table.where("vec_id = 0")).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten(flat).collect()} == {1}  # rank 1
    huge = spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(huge, Whitening(1)).collect()} == {(1 << 63) - 1} and whiten(huge).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# op13


def plain_clusters(rows, k=40, dim=64, rounds=5):
    fine = [(i, [math.floor(256 * float(c)) for c in e]) for i, e in rows if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([v for _, v in fine], object)
    first = sorted(range(len(fine)), key=lambda j: (fine[j][0] is None, hashlib.sha256(f"2:{fine[j][0]}".encode()).hexdigest(), fine[j][1]))[:k]
    c = x[first]

    def assign():
        d = np.array([[((v - m) ** 2).sum() for m in c] for v in x], object)
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        of, _ = assign()
        for j in range(len(c)):
            own = [v for v, o in zip(x, of) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    of, d = assign()
    inertia = Counter()
    for i, j in enumerate(of):
        inertia[j] += d[i][j]
    return sorted(((i, j, d[n][j], inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for n, ((i, _), j) in enumerate(zip(fine, of))), key=repr)


def test_clusters_follow_the_contract(spark):
    e = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op13_threshold_algorithm(spark, SF).collect()), key=repr) == plain_clusters(e)


@pytest.mark.parametrize("seed", range(6))
def test_the_walk_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    k, dims, high = [(1, 1, 5), (7, 3, 2), (40, 8, 3), (40, 64, 60), (5, 2, 1), (64, 4, 1 << 27)][seed]
    c, x = rng.integers(-high, high + 1, (k, dims)), rng.integers(-high, high + 1, (3000, dims))
    of, d = Lists(c).nearest(x)
    want = ((x[:, None, :].astype(float) - c[None]) ** 2).sum(2) if high > 1 << 20 else ((x[:, None, :] - c[None]) ** 2).sum(2)
    if high > 1 << 20:
        assert np.allclose(d, want.min(1))
    else:
        assert (of == want.argmin(1)).all() and (d == want.min(1)).all()  # argmin takes the smaller number of ties


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    small = Clusters(k=3, dim=4, rounds=2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(20)] + [(5, [0.5] * 4), (5, [0.5] * 4), (None, [0.25] * 4)]
    bad = [(30, None), (31, [1.0, None, 2.0, 3.0]), (32, [float("nan")] * 4), (33, [float("-inf")] * 4), (34, []), (35, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "cluster": F.lit("c"), "n": F.lit(2)})
    assert sorted(map(tuple, cluster_vectors(table, small).collect()), key=repr) == plain_clusters(rows, 3, 4, 2)
    assert cluster_vectors(table.where("false"), small).collect() == [] and cluster_vectors(table.where("vec_id >= 30"), small).collect() == []
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, cluster_vectors(few, small).collect()), key=repr) == plain_clusters(rows[:2], 3, 4, 2)
    huge = cluster_vectors(spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>"), Clusters(k=1, dim=4, rounds=1)).collect()
    assert {r.distance for r in huge} == {1 << 54}  # held at the bound
    with pytest.raises(ValueError):
        Clusters(k=1 << 20)


def test_scoring_gathers_weight_times_stretch_at_once():
    """One table by gate and state for each predictor, with the same result bit for bit as weights and stretches apart."""
    from siltloom.llm.context_mixing import CHAR_ROWS, CLIP, Mixer, Paths, spelled_bits

    rng = np.random.default_rng(3)
    b = spelled_bits([b"word%d" % i for i in range(500)], Paths(list(range(1, 257))), 12)
    mixer = Mixer(rng.integers(0, 9, (4, 1 << 12, 2)).astype(np.uint16), CHAR_ROWS)
    mixer.weights = rng.normal(0.3, 0.2, mixer.weights.shape).astype(np.float32)
    _, x, gate = mixer.inputs(b, False)
    y = np.zeros(len(gate), np.float32)
    for w, v in zip(mixer.weights.T.copy(), x):
        y += w.take(gate) * v
    assert (mixer.scored(b) == np.clip(y, -CLIP, CLIP)).all()
