"""Which texts hold a pattern, by a posting index of trigrams: candidates from intersected lists, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.sources.batches import bounded_batches, slices
from siltloom.sources.tables import stored

GRAM = 3
#: Lists that are intersected for a pattern, its shortest ones.
PROBES = 3


@dataclass(frozen=True)
class Postings:
    """``lists`` (scope..., gram, docs): each trigram with the texts that hold it, a row for each slice of texts; ``sizes`` (scope..., gram, n): how many texts of the scope hold it. Both can be stored and read back."""

    scope: tuple[str, ...]
    lists: DataFrame
    sizes: DataFrame


def grams_of(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` without ``text`` and with a row for each of its distinct trigrams (``gram``); texts of under three characters give none."""
    keys = [f for f in texts.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # long texts have many
                part = batch.slice(at, 256)
                rows, found = [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    own = sorted({t[j : j + GRAM] for j in range(len(t) - GRAM + 1)}) if t else []
                    rows += [i] * len(own)
                    found += own
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name).take(take) for f in keys], pa.array(found, pa.string())], [*[f.name for f in keys], "gram"])

    return texts.mapInArrow(run, T.StructType([*keys, T.StructField("gram", T.StringType())]))


def lists_of(texts: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Texts (scope..., doc, text) as rows (scope..., gram, docs): each trigram of a slice of texts with the texts that hold it, each once."""
    fields = {f.name: f for f in texts.schema}
    bounded_batches(texts.sparkSession)

    def posted(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = part.num_rows
        own = [t or "" for t in part.column("text").to_pylist()]
        places: dict[tuple, int] = {}
        keys = zip(*[part.column(c).to_pylist() for c in scope]) if scope else [()] * rows
        at = np.array([places.setdefault(k, len(places)) for k in keys], np.int64)
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        if len(codes) < GRAM:
            return
        met = np.zeros(int(codes.max()) + 1, bool)
        met[codes] = True
        letters = np.flatnonzero(met)
        n = len(letters)
        if n**3 * len(places) * rows >= 1 << 62 and rows > 1:  # a trigram, its scope and its text are one number
            for i, j in ((0, rows // 2), (rows // 2, rows)):
                yield from posted(part.slice(i, j - i))
            return
        of = np.repeat(np.arange(rows), [len(t) for t in own])
        code = (np.cumsum(met) - 1)[codes]
        gram = (code[:-2] * n + code[1:-1]) * n + code[2:]
        key = ((at[of[2:]] * n**3 + gram) * rows + of[2:])[of[:-2] == of[2:]]
        if not len(key):
            return
        gram, doc = np.divmod(np.unique(key), rows)
        starts = np.r_[0, np.flatnonzero(np.diff(gram)) + 1]
        where, gram = np.divmod(gram[starts], n**3)
        text = letters[np.stack([gram // (n * n), gram // n % n, gram % n], 1)].astype("<u4").tobytes().decode("utf-32-le")
        docs = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(doc)].astype(np.int32)), part.column("doc").take(pa.array(doc)))
        first = pa.array(np.unique(at, return_index=True)[1][where])
        yield pa.RecordBatch.from_arrays([*[part.column(c).take(first) for c in scope], pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string()), docs], [*scope, "gram", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield from posted(part)

    return texts.mapInArrow(run, T.StructType([*[fields[c] for c in scope], T.StructField("gram", T.StringType()), T.StructField("docs", T.ArrayType(fields["doc"].dataType))]))


def post(texts: DataFrame, scope: tuple[str, ...], doc: str = "doc", text: str = "text") -> Postings:
    """The index of texts (scope..., doc, text), stored. Each text is read once, whatever will be asked."""
    lists = stored(lists_of(texts.select(*scope, F.col(doc).alias("doc"), F.col(text).alias("text")), scope))
    return Postings(scope, lists, stored(lists.groupBy(*scope, "gram").agg(F.sum(F.size("docs")).alias("n"))))


def holding(patterns: DataFrame, index: Postings, texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(scope..., pattern, doc) of the texts that hold a pattern of their scope, for patterns (scope..., pattern).

    A pattern's trigrams are looked up in the sizes: where one is missing nothing holds it, else its three shortest lists are intersected. What is left is verified on
    the texts, so that a text meets a pattern only where it is likely to hold it. Patterns of under three characters have no trigram: texts of their scopes are scanned
    for these. Empty and null patterns are in no text.
    """
    scope = list(index.scope)
    asked = patterns.select(*scope, "pattern").where("pattern <> ''").distinct()
    long = asked.where(F.length("pattern") >= GRAM)
    grams = grams_of(long.withColumn("own", F.col("pattern")), "own").join(index.sizes, [*scope, "gram"], "left")
    ranked = grams.withColumns({
        "least": F.min(F.coalesce("n", F.lit(0))).over(W.partitionBy(*scope, "pattern")), "rank": F.row_number().over(W.partitionBy(*scope, "pattern").orderBy("n", "gram")), "probes": F.count("*").over(W.partitionBy(*scope, "pattern")),
    })
    probes = ranked.where((F.col("least") > 0) & (F.col("rank") <= PROBES)).select(*scope, "pattern", "gram", F.least("probes", F.lit(PROBES)).alias("probes"))
    met = probes.join(index.lists, [*scope, "gram"]).select(*scope, "pattern", "probes", F.explode("docs").alias("doc")).groupBy(*scope, "pattern", "doc").agg(F.count("*").alias("m"), F.first("probes").alias("probes")).where("m = probes")
    own = texts.select(*scope, F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = met.select(*scope, "pattern", "doc").join(own, [*scope, "doc"]).where(F.contains("text", "pattern")).select(*scope, "pattern", "doc")
    short = asked.where(F.length("pattern") < GRAM)
    if short.isEmpty():
        return found
    return found.union(short.join(own, scope).where(F.contains("text", "pattern")).select(*scope, "pattern", "doc"))
