"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words, each text scanned once."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltloom.llm.common import map_rows, saved

#: A-Z become a-z; other ASCII but digits and letters separates words; all bytes of non-ASCII characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Most bytes of benchmark text that a task holds; a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 32 << 20
#: Bytes whose words can be told apart by characters (1.1 million).
PART_BYTES = 4 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Windows:
    """The benchmark's windows as one Aho-Corasick automaton over numbers of words, a number a character.

    Every window of ``window`` words holds a block of ``(window + 1) // 2`` words that starts at a multiple of that in its item. The automaton's keys are these
    blocks, one node a word of the benchmark rather than one a word of each window; where a block occurs, the item's words before and after it are compared, and a stretch
    of ``window`` equal words or more is an occurrence of windows, all of its words hit. Items of fewer words are keys as they are.
    """

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts: dict[str, list] = {}
        for item, text in items:
            texts.setdefault(text, []).append(item)
        self.window, self.ids, self.lines, self.numbers = window, [], [], {}
        block = (window + 1) // 2
        found: dict[str, list[tuple[int, int]]] = {}
        for text, ids in texts.items():
            words = words_of(text)
            if not words:
                continue
            line = "".join(map(chr, (self.numbers.setdefault(w, len(self.numbers) + 1 + (len(self.numbers) >= 0xD7FF) * 0x800) for w in words)))  # no surrogates
            k = len(self.lines)
            self.lines.append(line)
            self.ids.append([i for i in ids if i is not None])
            if len(line) < window:
                found.setdefault(line, []).append((k, 0))
            else:
                for at in range(0, len(line) - block + 1, block):
                    found.setdefault(line[at : at + block], []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for key, places in found.items():
            self.machine.add_word(key, (len(key), tuple(places)))
        if found:
            self.machine.make_automaton()
        self.letters = {w: chr(n) for w, n in self.numbers.items()}
        del self.numbers

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit word ranges (start, end exclusive; merged, ascending) and the items found."""
        if not words or not self.lines:
            return [], set()
        get = self.letters.get
        line = "".join([get(w, "\0") for w in words])
        ranges: list[tuple[int, int]] = []
        items: set = set()
        seen: dict[tuple[int, int], int] = {}  # end of the stretch last compared on an item's diagonal
        for last, (size, places) in self.machine.iter(line):
            start = last + 1 - size
            for k, at in places:
                own = self.lines[k]
                if len(own) < self.window:
                    a, b = start, last + 1
                elif seen.get((k, start - at), -1) > start:
                    continue
                else:
                    a, b = _stretch(line, start, own, at, size)
                    seen[k, start - at] = b
                    if b - a < self.window:
                        continue
                ranges.append((a, b))
                items.update(self.ids[k])
        return _merged(ranges), items


def _stretch(line: str, start: int, own: str, at: int, size: int) -> tuple[int, int]:
    """The longest stretch of ``line`` around the ``size`` characters at ``start`` that equals ``own`` around ``at``."""
    a, b = start, start + size
    shift = at - start
    while a > 0 and a + shift > 0 and line[a - 1] == own[a - 1 + shift]:
        a -= 1
    while b < len(line) and b + shift < len(own) and line[b] == own[b + shift]:
        b += 1
    return a, b


@lru_cache(maxsize=1)
def _windows(held, window: int) -> list[Windows]:
    """Made once a Python worker and broadcast; each part has few enough words to number them by characters."""
    parts: list[list] = [[]]
    size = 0
    for item, text in held.value:
        size += len(text.encode("utf-8", "surrogatepass"))
        if size > PART_BYTES and parts[-1]:
            parts.append([])
            size = len(text.encode("utf-8", "surrogatepass"))
        parts[-1].append((item, text))
    return [Windows(part, window) for part in parts]


def word_spans(text: str) -> list[tuple[int, int]]:
    """The words' places in the original text, in code points."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def find_overlaps(df: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", offsets: bool = True, prefix: str = "") -> DataFrame:
    """``df`` with ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window), ``items`` (sorted ids) and ``hits``
    (start and end of the hit stretches in code points of the original text; null if ``offsets`` is off). Item ids keep their type.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; items without words never match.
    The windows of an item without id are hits as well, but it is listed nowhere; one without text has none.
    A null or empty text has no words and no hits. The four names are led by ``prefix``; columns of ``df`` with these names are replaced.
    The benchmark's size is summed first. It goes to every task in passes of at most AUTOMATON_BYTES, so that memory is bounded;
    one pass serves the usual benchmark. The text isn't shuffled.
    """
    names = tuple(f"{prefix}{n}" for n in ("n_words", "n_hit", "items", "hits"))
    rest = df.drop(*names)
    bench = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    passes = -(-(bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // AUTOMATON_BYTES) or 1
    bench = bench.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(passes)))
    kind = T.ArrayType(bench.schema["i"].dataType)
    pairs = T.ArrayType(T.ArrayType(T.IntegerType()))
    out = rest.withColumns({"__ranges": F.lit(None).cast(pairs), "__items": F.lit(None).cast(kind), "__n": F.lit(0).cast("long"), "__hits": F.lit(None).cast(pairs)})
    for p in range(passes):
        part = df.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in bench.where(F.col("p") == p).collect()])
        out = _pass(out if p == 0 else saved(out), part, window, text, kind, offsets and p == passes - 1)
    n_hit = F.aggregate("__ranges", F.lit(0).cast("long"), lambda s, r: s + (r[1] - r[0]).cast("long"))
    return out.select(*rest.columns, *[c.alias(n) for c, n in zip((F.col("__n"), n_hit, F.col("__items"), F.col("__hits")), names)])


def _pass(df: DataFrame, items, window: int, text: str, kind: T.ArrayType, offsets: bool) -> DataFrame:
    made = {"__ranges": T.ArrayType(T.ArrayType(T.IntegerType())), "__items": kind, "__n": T.LongType(), "__hits": T.ArrayType(T.ArrayType(T.IntegerType()))}
    others = [f for f in df.schema if f.name not in made]
    keep = [f.name for f in others]

    def run(batch: pa.RecordBatch) -> dict:
        windows = _windows(items, window)
        out: dict = {name: [] for name in made}
        for t, r0, i0 in zip(batch.column(text).to_pylist(), batch.column("__ranges").to_pylist(), batch.column("__items").to_pylist()):
            words = words_of(t) if t else []
            n, (r, i) = len(words), windows[0].scan(words)
            for more in windows[1:]:
                r1, i1 = more.scan(words)
                r, i = _merged([*r, *r1]), i | i1
            if r0:
                r = _merged([*map(tuple, r0), *r])
            spans = word_spans(t) if offsets and r else []
            for name, value in zip(made, (r, sorted(i.union(i0 or ())), n, [[spans[a][0], spans[b - 1][1]] for a, b in r] if offsets else None)):
                out[name].append(value)
        return {name: batch.column(name) for name in keep} | out

    return map_rows(df, text, T.StructType([*others, *(T.StructField(name, t) for name, t in made.items())]), run)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op8_aho_corasick(spark, sf_dir: str) -> DataFrame:
    """All documents against the benchmark by 13-word windows; contaminated from 5 % of hit words on. ``hits`` are the places of the hit
    stretches in the original text, as start:end in code points, comma-joined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h[0].cast("string"), h[1].cast("string"))), ",").alias("hits"),
    )
