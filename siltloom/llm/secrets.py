"""Secret scans: spans by pattern, and weak candidates that count only where complementary parts of a credential meet."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.llm.common import lookup, map_rows, saved

# The base patterns with the length each match needs, in order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so a shorter one holds no longer match
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")

# Weak parts, which alone say little.
WEAK_ID = re.compile(r"""(?:client_?id|account(?:_?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{20,}", re.A)
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])""", re.A)
WEAK_ASSIGN_LEAST = 6
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
ID, SECRET, END = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap inside a kind, ascending."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def parts_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, role, scope, weak) of all parts; empty unless a secret and another role occur. A scope ends at a blank line."""
    strong = [(s, e, ID if k == 1 else SECRET, False) for s, k, e in base]
    taken = [(s, e) for s, _, e in base]

    def free(m: re.Match) -> bool:
        at = bisect_right(taken, (m.end(),)) - 1
        return at < 0 or max(e for _, e in taken[max(0, at - 2) : at + 1]) <= m.start()

    weak = [(m.start(), m.end(), SECRET, True) for m in ASSIGN.finditer(text) if WEAK_ASSIGN_LEAST <= m.end(2) - m.start(2) < ASSIGN_LEAST]
    weak += [(m.start(), m.end(), SECRET, True) for m in WEAK_SECRET.finditer(text) if free(m)]
    if not weak and not any(p[2] == SECRET for p in strong):
        return []
    weak += [(m.start(), m.end(), ID, True) for m in WEAK_ID.finditer(text)]
    weak += [(m.start(), m.end(), ID, True) for m in ACCESS.finditer(text) if 8 <= m.end() - m.start() < ACCESS_LEAST]
    weak += [(m.start(), m.end(), END, True) for m in ENDPOINT.finditer(text)]
    if len({p[2] for p in strong + weak}) < 2 or not weak:
        return []
    ends = [m.start() for m in SCOPE_END.finditer(text)]
    return [(s, e, role, bisect_right(ends, s), w) for s, e, role, w in sorted(set(strong + weak))]


def scan_secrets(docs: DataFrame, reach: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: (doc_id, base, linked), both arrays of (start, kind, end) in code points, end exclusive, ascending; kind indexes KINDS.

    Base spans come from the whole text. Weak parts (short assignments, mixed-case tokens, user names, short access names, addresses) are
    joined with complementary parts by interval: same scope, starts at most ``reach`` apart; a weak secret needs an identifier or endpoint, a weak
    identifier or endpoint needs a secret. Base spans count as parts too. The join looks up the first and last start of each role in cells of
    ``reach`` code points, the own one and its neighbours, so its rows follow the parts and never the pairs.
    Null and empty texts have no spans; rows that repeat each give their own result row.
    """

    def run(batch: pa.RecordBatch) -> dict:
        base, parts = [], []
        for t in batch.column("text").to_pylist():
            found = base_spans(t) if t else []
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            parts.append([{"start": s, "end": e, "role": r, "scope": c, "weak": w} for s, e, r, c, w in (parts_of(t, found) if t else [])])
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "base": base, "parts": parts}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = saved(map_rows(rows, "text", f"doc_id {kind}, th long, base array<struct<start:int,kind:int,end:int>>, parts array<struct<start:int,end:int,role:int,scope:int,weak:boolean>>", run))
    parts = found.where(F.size("parts") > 0).select("doc_id", "th", F.inline("parts")).withColumn("cell", F.floor(F.col("start") / reach).cast("int")).withColumn("who", F.xxhash64("doc_id", "th"))
    cells = parts.groupBy("who", "scope", "role", "cell").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    wanted = (
        parts.where("weak").withColumn("other", F.explode(F.when(F.col("role") == SECRET, F.array(F.lit(ID), F.lit(END))).otherwise(F.array(F.lit(SECRET)))))
        .withColumn("near", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    )
    other = saved(cells.select(F.col("who").alias("w2"), F.col("scope").alias("s2"), F.col("role").alias("other2"), F.col("cell").alias("near2"), "low", "high"))
    met = wanted.join(other, (F.col("who") == F.col("w2")) & (F.col("scope") == F.col("s2")) & (F.col("other") == F.col("other2")) & (F.col("near") == F.col("near2")))
    close = ((F.col("near") == F.col("cell")) | ((F.col("near") < F.col("cell")) & (F.col("high") >= F.col("start") - reach)) | ((F.col("near") > F.col("cell")) & (F.col("low") <= F.col("start") + reach)))
    linked = saved(
        met.where(close).groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set(F.struct("start", (F.col("role") + 3).alias("kind"), "end"))).alias("linked"))
    )
    out = lookup(found.select("doc_id", "th", "base"), linked, ["doc_id", "th"], most=20_000)
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("linked"))


def span_text(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_multipart_credentials(spark, sf_dir: str) -> DataFrame:
    """Base spans and linked parts of every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text("base"), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )
