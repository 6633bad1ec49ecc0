"""Python tasks hold batches of bounded bytes, whatever the tables' size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltloom.operators import chunking as C
from siltloom.operators import entities as E
from siltloom.operators import vectors as V
from siltloom.sources import batches as B


@pytest.mark.parametrize("use", ["chunk_files", "scan_files", "embed", "vector_topk"])
def test_bounded_batches(spark, use):
    own = spark.newSession()
    files = own.createDataFrame([("r", "b", "f.py", "x = 1", [1.0])], "repo string, branch string, file_path string, content string, v array<double>")
    if use == "chunk_files":
        C.chunk_files(files)
    elif use == "scan_files":
        E.scan_files(files)
    elif use == "embed":
        V.embed(files, V.hashed_embedding(4), 4, "content")
    else:
        V.vector_topk(files.select(F.lit(1).alias("query_id"), F.col("v").alias("vector")), files.select(F.lit(1).alias("chunk_id"), "repo", "branch", F.col("v").alias("embedding")), 1)
    assert 0 < B.byte_count(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= B.BATCH_BYTES


def test_chunks_of_many_large_files_come_in_parts(spark, monkeypatch):
    line = "UPDATE t SET x = 1;"
    text = "\n".join([line] * 500)  # a chunk a line, but for the first two
    d = spark.createDataFrame([("r", "b", f"{i}.sql", text if i % 2 else ("small" if i % 4 else None)) for i in range(40)], "repo string, branch string, file_path string, content string").coalesce(1)
    rows = {(r["file_path"], r["position"]): r["text"] for r in C.chunk_files(d).collect()}
    want = {(f"{i}.sql", 0): "small" for i in range(0, 40, 2) if i % 4}
    want |= {(f"{i}.sql", p): f"{line}\n{line}" if not p else line for i in range(1, 40, 2) for p in [0, *range(2, 500)]}
    assert rows == want and C.chunk_rejects(d).isEmpty()
    monkeypatch.setattr(C, "SLICE_BYTES", 1 << 14)
    batch = pa.RecordBatch.from_arrays([pa.array([x] * 20) for x in ("r", "b", "f", "sql", text)], [*C.KEYS, "text"])
    sizes = [b.nbytes for b in C._chunk_batches(iter([batch]))]
    assert len(sizes) > 20 and max(sizes) < 1 << 15


def test_scores_are_held_in_blocks(monkeypatch):
    monkeypatch.setattr(V, "SCORES", 300)
    monkeypatch.setattr(V, "WIDE", 16)
    rng = np.random.default_rng(5)
    x, m, k = rng.integers(-2, 3, (200, 3)).astype(float), rng.integers(-2, 3, (50, 3)).astype(float), 4
    place = ["a" if i % 3 else "b" for i in range(200)]
    wanted = [[None, "a", "b"][i % 3] for i in range(50)]
    q = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(m.tolist(), pa.list_(pa.float64())), pa.array(wanted, pa.string()), pa.nulls(50, pa.string())], ["query_id", "vector", "repo", "branch"])
    best, sizes, meet = V.Best(q, k), [], V.Best._meet
    monkeypatch.setattr(V.Best, "_meet", lambda self, rows, y, *a: (sizes.append(len(rows) * y.shape[1]), meet(self, rows, y, *a)))
    for i in range(0, 200, 60):
        n = len(x[i : i + 60])
        best.add(V.unit(x[i : i + 60]), pa.array(range(i, i + n)), pa.array(place[i : i + n]), pa.nulls(n, pa.string()))
    got = best.cut()
    assert max(sizes) <= 300
    scores = np.round(V.unit(m) @ V.unit(x).T, 12)
    want = [(i, j) for i in range(50) for _, j in sorted((-scores[i, j], j) for j in range(200) if wanted[i] in (None, place[j]))[:k]]
    assert list(zip(got.column("query_id").to_pylist(), got.column("chunk_id").to_pylist())) == want


def test_line_blocks_are_derived_once(spark):
    go, python = "func f() {\n" + "x" * 9000 + "\nfunc g() {", "a = 1\n" + "x" * 9000 + "\ndef f():"
    d = spark.createDataFrame([("go", "1", go), ("python", "2", python), ("python", "3", go), ("go", "4", "func a\nfunc b"), ("go", "5", None)], "language string, file_path string, text string")
    d = d.select("language", F.lit("r").alias("repo"), F.lit("b").alias("branch"), "file_path", F.regexp_replace("text", "zzz", "").alias("content"))
    out = C.split_by_line_pattern(d)
    assert sorted((r["file_path"], r["position"]) for r in out.collect()) == [("1", 0), ("1", 2), ("2", 0), ("2", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("zzz") == 1
