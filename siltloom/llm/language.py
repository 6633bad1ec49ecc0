"""Language identification by fusing evidence: text likelihood, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltloom.llm.common import lookup, map_rows, saved

#: Soft counts are whole numbers of this unit, so that their sums don't depend on the order of rows.
UNIT = 1_000_000
UNKNOWN = "und"
_BAD_BLOCK = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


@dataclass(frozen=True)
class Fusion:
    """How evidence is weighed. ``sample``: training documents of each language, about; ``evidence``: number of trigrams beyond which
    a text counts no more (they aren't independent); ``host`` and ``domain``: pseudo-pages by which a host leans on its domain, and a domain on the whole.
    ``cells``: most numbers of the model's table: with over 256 languages trigrams share fewer buckets (256 at least), so that none is left out.
    """

    sample: int = 4000
    evidence: int = 40
    smooth: float = 0.5
    host: float = 5.0
    domain: float = 20.0
    cells: int = 1 << 24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])


def trigrams(text: str) -> np.ndarray:
    """16-bit hash of every character trigram with a letter in its middle; other characters than letters count as blanks."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    c = np.where(ok, c, 32).astype(np.uint32)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16))[ok[1:-1]]


def page_text(page: str) -> str:
    return html.unescape(_TAG.sub(" ", _BAD_BLOCK.sub(" ", page)))


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets (a power of 2) x languages, log probabilities

    def score(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams, and the log likelihood of each language and, last, of none (every trigram equally likely)."""
        t = trigrams(text) if text else np.empty(0, np.uint32)
        own = self.table[t % len(self.table)].sum(0, dtype=np.float64)
        return len(t), np.append(own, -len(t) * np.log(len(self.table)))


def train(labelled: DataFrame, fusion: Fusion = Fusion()) -> TextModel:
    """Naive Bayes on character trigrams from (id, text, lang), on a bounded sample: about ``fusion.sample`` rows of each
    language, chosen by a hash of the id. The counts are a grouped aggregation; what reaches the driver is the model, ``fusion.cells`` numbers at most
    (256 a language beyond 65,536 languages). Rows without language or text are left out; without any labelled row the model has no languages.
    """
    rows = labelled.select(F.col("id"), F.col("text"), F.col("lang")).where("lang is not null and text is not null and lang <> ''")
    sizes = saved(rows.groupBy("lang").count())
    names = tuple(sorted(r[0] for r in sizes.select("lang").collect()))
    buckets = 1 << 16
    while buckets > 256 and buckets * len(names) > fusion.cells:
        buckets //= 2
    if not names:
        return TextModel((), np.zeros((buckets, 0), np.float32))
    rates = sizes.select("lang", F.least(F.lit(1.0), fusion.sample / F.col("count")).alias("rate"))
    chosen = lookup(rows, rates, ["lang"], "inner").where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("text", "lang")

    def run(batch: pa.RecordBatch) -> dict:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            sums[lang] = sums.get(lang, 0) + np.bincount(np.unique(trigrams(text) % buckets), minlength=buckets)  # once a text, so that a long odd one can't rule
        langs, places, counts = [], [], []
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            langs += [lang] * len(at)
            places += at.tolist()
            counts += n[at].tolist()
        return {"lang": langs, "bucket": places, "n": counts}

    sums = map_rows(chosen, "text", "lang string, bucket int, n long", run).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = saved(sums).toArrow()
    place = pa.compute.index_in(counts.column("lang"), value_set=pa.array(names)).to_numpy()
    full = np.zeros((buckets, len(names)), np.float32)
    full[counts.column("bucket").to_numpy(), place] = counts.column("n").to_numpy()
    return TextModel(names, (np.log(full + fusion.smooth) - np.log(full.sum(0, dtype=np.float64) + fusion.smooth * buckets)).astype(np.float32))


def identify(rows: DataFrame, model: TextModel, markup: bool, fusion: Fusion = Fusion()) -> DataFrame:
    """Languages of (id, text, host, suffix, declared): adds to id the columns declared, host, n (trigrams), text_lang, lang and posterior.

    Posterior of a language: text likelihood (tempered to ``evidence`` trigrams) x P(declared | language) x P(suffix | language) x prior of
    the host. All three tables are grouped sums of the texts' own soft votes. A host's prior leans on its domain (the last two labels),
    the domain's on the whole; a row's own vote is taken out of every table that it looks up. ``und`` stands for a text that fits no language better than chance;
    a row with no letters at all is ``und`` with posterior 0. With ``markup`` the text is HTML, and ``declared`` is read from it where it is null.
    Null host, suffix or declared is no evidence. Ties go to the first language by code point. Repeated rows are rows of their own; an empty table
    gives an empty result; other columns are ignored.
    """
    langs = [*model.languages, UNKNOWN]
    k = len(langs)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m: TextModel = held.value
        n, ll, votes, declared = [], [], [], []
        for text, said in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist()):
            if markup and text:
                found = _LANG.search(text) if said is None else None
                said = found[1].lower() if found else said
                text = page_text(text)
            count, x = m.score(text)
            x = x * (min(1.0, fusion.evidence / count) if count else 0.0)
            p = np.exp(x - x.max())
            n.append(count)
            ll.append(x)
            votes.append(np.round(p / p.sum() * UNIT).astype(np.int64) if count else np.zeros(len(x), np.int64))
            declared.append(said)
        return {"id": batch.column("id"), "host": batch.column("host"), "suffix": batch.column("suffix"), "declared": declared, "n": n, "ll": ll, "votes": votes}

    kind = rows.schema["id"].dataType.simpleString()
    base = saved(
        map_rows(rows.select("id", "text", "host", "suffix", "declared"), "text", f"id {kind}, host string, suffix string, declared string, n int, ll array<double>, votes array<long>", run)
        .withColumn("domain", F.substring_index("host", ".", -2))
    )

    def sums(df: DataFrame, keys: list[str]) -> DataFrame:
        """Sums of ``votes`` by keys. A row votes for few languages, so that only those are added up."""
        each = df.select(*keys, F.posexplode("votes").alias("i", "v")).where("v <> 0").groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        known = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
        return saved(known.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("votes")))

    hosts = sums(base.where("host is not null"), ["host", "domain"])
    domains = sums(hosts, ["domain"])
    found = sums(base.select("votes"), []).first()
    whole = F.array(*[F.lit(x) for x in (found["votes"] if found else [0] * k)])
    own = F.col("votes")

    def lean(all_votes: Column, prior: Column, weight: float) -> Column:
        """Shares of the languages among the votes but the row's own, leaning on ``prior`` by ``weight`` votes."""
        rest = F.zip_with(all_votes, own, lambda s, v: F.greatest(s - v, F.lit(0)).cast("double") / UNIT)
        return F.get(F.transform(F.array(rest), lambda r: F.get(F.transform(F.array(F.aggregate(r, F.lit(0.0), lambda a, x: a + x)), lambda mass: F.zip_with(r, prior, lambda x, p: (x + weight * p) / (mass + weight))), F.lit(0))), F.lit(0))

    def given(key: str) -> tuple[DataFrame, Column]:
        """log P(key | language), smoothed, but for the row's own vote; a null key is no evidence."""
        d = sums(base.where(F.col(key).isNotNull()), [key])
        values = d.count()
        total = sums(d.select("votes"), []).first()
        total = F.array(*[F.lit(x) for x in (total["votes"] if total else [0] * k)])
        less = lambda all_votes: F.zip_with(all_votes, own, lambda s, v: F.greatest(s - v, F.lit(0)) / UNIT)
        score = F.zip_with(less(F.col(f"{key}_votes")), less(total), lambda x, t: F.log((x + 0.5) / (t + 0.5 * values)))
        return d.withColumnRenamed("votes", f"{key}_votes"), score

    declared, declared_ll = given("declared")
    suffix, suffix_ll = given("suffix")
    d = lookup(lookup(base, declared, ["declared"]), suffix, ["suffix"])
    d = lookup(d, hosts.select("host", F.col("votes").alias("host_votes")), ["host"])
    d = lookup(d, domains.withColumnRenamed("votes", "domain_votes"), ["domain"])
    none = F.array(*[F.lit(0.0)] * k)
    chance = F.array(*[F.lit(1.0 / k)] * k)
    top = lean(whole, chance, float(k))
    prior = F.when(F.col("host_votes").isNotNull(), lean(F.col("host_votes"), lean(F.col("domain_votes"), top, fusion.domain), fusion.host)).otherwise(top)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(F.col("ll"), F.transform(prior, lambda p: F.log(p))), add(F.coalesce(declared_ll, none), F.coalesce(suffix_ll, none)))
    d = d.withColumn("score", total).withColumn("best", F.array_max("score"))
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    some = F.col("n") > 0
    return d.select(
        "id", "declared", "host", "n", F.when(some, pick("ll")).otherwise(UNKNOWN).alias("text_lang"),
        F.when(some, pick("score")).otherwise(UNKNOWN).alias("lang"), F.when(some, F.round(1.0 / mass, 6)).otherwise(0.0).alias("posterior"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to the input of ``identify``: host without www, suffix its last label; nulls where there is no host."""
    host = F.nullif(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit(""))
    host = F.regexp_replace(host, r"^www\.|\.$", "")
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), host.alias("host")).withColumns({"suffix": F.substring_index("host", ".", -1), "declared": F.lit(None).cast("string")})


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", "lang")


def op1_evidence_fusion(spark, sf_dir: str) -> DataFrame:
    """Language of all pages; the text model is trained on labelled documents."""
    model = train(labelled(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    found = identify(page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")), model, markup=True)
    return found.select(F.col("id").alias("page_id"), "host", "declared", F.col("n").alias("n_trigrams"), "text_lang", "lang", "posterior")


def keep_identified(docs: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:
    """Documents (doc_id, text, lang, source, ...) whose text is in one of the corpus's languages; those that fit none better than chance go.

    The declared language is ``lang``; the source takes the host's place; there is no suffix. Columns stay as they are.
    A row is judged by its own content: rows of one id are told apart by a hash of their columns; a document of known language stays, whatever its label says.
    Where no row has a language, none can be rejected and all stay. Repeated rows stay or go together; an empty table gives an empty result.
    """
    key = F.xxhash64(*[F.col(c) for c in ("doc_id", "text", "lang", "source")])
    rows = docs.select(key.alias("id"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("lang").alias("declared"))
    model = train(labelled(docs), fusion)
    if not model.languages:
        return docs
    found = identify(rows, model, markup=False, fusion=fusion)
    gone = saved(found.where(F.col("lang") == UNKNOWN).select(F.col("id").alias("__key")).distinct().withColumn("__gone", F.lit(True)))
    return lookup(docs.withColumn("__key", key), gone, ["__key"]).where("__gone is null").select(*docs.columns)
