"""Indexing repositories: files to chunks with vectors, nodes, edges and statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.functions.paths import is_supported, not_ignored
from siltloom.operators.catalog import index_stats
from siltloom.operators.entities import entities_of, index_chunks, rejects_of, scan_once
from siltloom.operators.graph import merge_nodes, resolve_edges
from siltloom.operators.sqlrefs import inline_sql
from siltloom.operators.vectors import embed, validate_vectors
from siltloom.sources.files import non_blank
from siltloom.sources.snapshots import Snapshots
from siltloom.sources.tables import replace_slice, stored


def index_repos(files: DataFrame, fn: Callable[[list[str]], np.ndarray], dim: int) -> dict[str, DataFrame]:
    """Files (repo, branch, file_path, content) of any number of slices to the tables chunks, nodes, edges and stats; ``rejects`` holds invalid vectors,
    ``file_rejects`` files that can't be scanned.

    Each distinct text is scanned once, whatever the number of branches that hold it; the result is stored, as chunks, nodes, edges, statistics and rejects all need it.
    """
    ok = non_blank(files.where(is_supported(F.col("file_path")) & not_ignored(F.col("file_path"))))
    scanned = stored(scan_once(ok))
    entities = entities_of(scanned)
    plain = index_chunks(ok, entities)
    java = F.col("language") == "java"
    key = ["repo", "branch", "file_path", "position", "entity_id"]
    chunks = inline_sql(plain.where(java), ok, key).unionByName(plain.where(~java))
    chunks = chunks.withColumn("chunk_id", F.sha1(F.concat_ws("\x01", "repo", "branch", "file_path", F.col("position").cast("string"), F.coalesce("entity_id", F.lit("")), F.sha1("text"))))
    good, bad = validate_vectors(embed(chunks, fn, dim), dim)
    nodes = merge_nodes(entities)
    return {"chunks": good, "rejects": bad, "file_rejects": rejects_of(scanned), "nodes": nodes, "edges": resolve_edges(entities, nodes), "stats": index_stats(ok, entities, chunks)}


def store(tables: dict[str, DataFrame], root: str, slices: DataFrame) -> None:
    """Replace the slices of the stored chunks, nodes and edges."""
    for name in ("chunks", "nodes", "edges"):
        replace_slice(tables[name], f"{root}/{name}", slices)


def publish(tables: dict[str, DataFrame], root: str, slices: DataFrame, dim: int | None = None) -> int:
    """The slices' chunks, nodes, edges and statistics as the next version of a snapshot store: readers see all of them or none. Returns the version."""
    stats = tables["stats"].select("repo", "branch", *[c for c in tables["stats"].columns if c not in ("repo", "branch")])
    return Snapshots(slices.sparkSession, root).replace({n: tables[n] for n in ("chunks", "nodes", "edges")} | {"stats": stats}, slices, dim)
