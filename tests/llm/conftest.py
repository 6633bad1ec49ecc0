import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank and very long texts, repeated rows, ties, and columns whose names the operators use inside."""
    long_text = " ".join(f"word{i % 997} x{i}" for i in range(40_000))
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and then it rests a while under a tree", "en", "src1"),
        (2, None, "en", "src1"),
        (3, "", None, "src2"),
        (4, " \t\n ", "en", None),
        (5, long_text, "en", "src1"),
        (6, long_text + " tail", "en", "src3"),
        (7, passage + " seven", "de", "src2"),
        (8, "eight " + passage, "de", "src2"),
        (8, "eight " + passage, "de", "src2"),
        (9, "Ünïcödé 𝒳 text\nline two\n\nline two", None, None),
        (None, "nobody knows this one but it has words in it all the same", "en", "src1"),
        (None, None, None, None),
        (10, "a", "en", "src1"),
        (11, "a", "en", "src1"),
    ]
    named = [(*r, len(r[1] or ""), 1, 2, 3, "x", "y", 4.0, "z") for r in rows]
    return spark.createDataFrame(named, "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, slot int, id string, size string, taken double, rep string")
