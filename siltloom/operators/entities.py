"""Code entities: scanned declarations, imported ones, and their chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.functions.paths import ast_language
from siltloom.functions.text import CLASS_LIMIT, class_notice, entity_embed_text, entity_id, truncate
from siltloom.operators.scopes import scan_source
from siltloom.sources.batches import SLICE_BYTES, bounded_batches
from siltloom.sources.files import content_store

RELATION = "array<struct<type:string,target_name:string,target_type:string,properties:map<string,string>>>"
ENTITY = (
    "type string, name string, file_path string, repo string, branch string, language string, start_line int, end_line int, "
    f"signature string, docstring string, code string, annotations array<string>, relations {RELATION}"
)
_NAMES = [f.split(" ")[0] for f in re.split(r", (?=\w+ (?:string|int|array))", ENTITY)]


def scan_files(files: DataFrame) -> DataFrame:
    """Files (repo, branch, file_path, content) to entities and rejects in one pass: rows of entities, whose ``error`` is null, and one row with the reason for each
    file that the scanner can't take. Files in other languages and null contents give no rows. Store the result where both are needed.

    Batches are bounded by their bytes, and about SLICE_BYTES of entities are held at a time.
    """
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for repo, branch, path, content, language in pdf.itertuples(index=False):
                of = {"repo": repo, "branch": branch, "file_path": path}
                try:
                    found = [e | of for e in scan_source(content, language)]
                except Exception as e:
                    found = [of | {"language": language, "error": f"{type(e).__name__}: {e}"}]
                out += found
                held += sum(1024 + len(e.get("code") or "") for e in found)
                if held >= SLICE_BYTES:
                    yield pd.DataFrame(out, columns=[*_NAMES, "error"], dtype=object)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=[*_NAMES, "error"], dtype=object)

    language = F.col("language") if "language" in files.columns else ast_language(F.col("file_path"))
    known = files.select("repo", "branch", "file_path", "content", language.alias("language")).where("language is not null and content is not null")
    return known.mapInPandas(run, f"{ENTITY}, error string")


def scan_once(files: DataFrame) -> DataFrame:
    """The rows of ``scan_files`` with each distinct text scanned once for each language, however many paths of branches and repos hold it."""
    paths, texts = content_store(files.withColumn("language", ast_language(F.col("file_path"))).where("language is not null and content is not null").select("repo", "branch", "file_path", "content", "language"))
    kinds = paths.select("h", "language").distinct().join(texts, "h")
    scanned = scan_files(kinds.select(F.lit("").alias("repo"), F.lit("").alias("branch"), F.col("h").alias("file_path"), "content", "language"))
    own = scanned.withColumnRenamed("file_path", "h").drop("repo", "branch")
    return own.join(paths, ["h", "language"]).select(*scanned.columns)


def entities_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("error is null").drop("error")


def rejects_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("error is not null").select("repo", "branch", "file_path", "error")


def scan_declarations(files: DataFrame) -> DataFrame:
    """Files (repo, branch, file_path, content) to entities of Python, Java, JavaScript, TypeScript and Go: a lexer and a stack of scopes over whole texts.

    The contract is the entity table: line span, signature, comment above, code, annotations, relations.
    """
    return entities_of(scan_files(files))


def scan_rejects(files: DataFrame) -> DataFrame:
    """Files on which the scanner fails, with the reason."""
    return rejects_of(scan_files(files))


def entities_from_json(raw: DataFrame, json: str = "json", language: str = "java") -> DataFrame:
    """Entities from (repo, branch, json) rows of an external parser, ``{"entities": [...]}``: absent fields take their defaults, language and slice are the request's."""
    parsed = raw.select("repo", "branch", F.inline(F.from_json(json, f"entities array<struct<{', '.join(f'{n}:{t}' for n, t in _json_fields())}>>")["entities"]))
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c)
    return parsed.select(
        text("type", "Class"), text("name"), text("file_path"), "repo", "branch", F.lit(language).alias("language"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"),
        "signature", "docstring", text("code"), F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations"), F.coalesce("relations", F.array().cast(RELATION)).alias("relations"),
    )


def _json_fields() -> list[tuple[str, str]]:
    return [("type", "string"), ("name", "string"), ("file_path", "string"), ("start_line", "int"), ("end_line", "int"), ("signature", "string"), ("docstring", "string"), ("code", "string"), ("annotations", "array<string>"), ("relations", RELATION)]


def entity_chunks(entities: DataFrame) -> DataFrame:
    """One chunk an entity, at its first line; the code of large types is cut with a notice."""
    large = F.col("type").isin("Class", "Interface", "Enum")
    text = F.when(large, truncate(F.col("code"), CLASS_LIMIT, class_notice(F.col("code")))).otherwise(F.col("code"))
    return entities.select(
        "repo", "branch", "file_path", "language", F.col("start_line").alias("position"), text.alias("text"), entity_embed_text().alias("embed_text"),
        entity_id(*map(F.col, ("repo", "branch", "file_path", "type", "name"))).alias("entity_id"), F.col("type").alias("ast_type"), F.col("name").alias("ast_name"), F.col("signature").alias("ast_signature"),
    )


def index_chunks(files: DataFrame, entities: DataFrame, fallback: bool = False) -> DataFrame:
    """Chunks of all files: those with a scanner by their entities, others by blocks. A scanned file without entities yields nothing, or its blocks with ``fallback``."""
    from siltloom.operators.chunking import chunk_files

    scanned = ast_language(F.col("file_path"))
    plain = files.where(scanned.isNull())
    if fallback:
        plain = plain.unionByName(files.where(scanned.isNotNull()).join(entities.select("repo", "branch", "file_path").distinct(), ["repo", "branch", "file_path"], "left_anti").select(*files.columns))
    return entity_chunks(entities).unionByName(chunk_files(plain))
