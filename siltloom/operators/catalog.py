"""Reports on what is indexed and what could be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltloom.functions.paths import is_supported, not_ignored
from siltloom.functions.text import PREVIEW, truncate
from siltloom.sources.tables import stored


def eligible_files(files: DataFrame) -> DataFrame:
    """Files to be indexed in each slice: count and sorted paths."""
    ok = files.where(is_supported(F.col("file_path")) & not_ignored(F.col("file_path")))
    return ok.groupBy("repo", "branch").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("file_path")).alias("paths"))


def ranked(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, from 1 on in each scope by ``order`` (unique in a scope), without bringing a scope's rows together: rows are sorted by ranges and stored, each knowing its place
    in its range; what lies in earlier ranges comes from sums of the ranges' counts, a row for each scope and range."""
    sorted_rows = df.repartitionByRange(*scope, *order).sortWithinPartitions(*scope, *order)
    placed = stored(sorted_rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    counts = placed.groupBy(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(scope)], F.col("__p").alias("__q")).agg(F.count("*").alias("n"), F.min("__i").alias("__first"))
    before = F.sum("n").over(W.partitionBy(*[f"__s{i}" for i in range(len(scope))]).orderBy("__q").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("n")
    on = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(scope)] + [F.col("__p") == F.col("__q")]
    out = placed.join(starts, on).withColumn("rank", (F.col("__before") + F.col("__i") - F.col("__first") + 1).cast("long"))
    return out.select(*df.columns, "rank")


def ranked_files(files: DataFrame) -> DataFrame:
    """The eligible files of each slice one by one: (repo, branch, file_path, rank). The form of ``eligible_files`` for slices of any size."""
    ok = files.where(is_supported(F.col("file_path")) & not_ignored(F.col("file_path"))).select("repo", "branch", "file_path").distinct()
    return ranked(ok, ["repo", "branch"], ["file_path"])


def indexed_repos(nodes: DataFrame) -> DataFrame:
    return nodes.where("repo <> ''").select("repo").distinct()


def repo_card(nodes: DataFrame) -> DataFrame:
    """The indexed repos as one text; a hint if there are none. The list is short: one line a repo."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("repo")), lambda r: F.concat(F.lit("- `"), r, F.lit("`"))), "\n")
    none = F.lit("No hay repositorios indexados. Usa: indexa org/repo")
    return indexed_repos(nodes).agg(F.when(F.count("*") > 0, F.concat(F.lit("## Repositorios indexados\n\n"), lines)).otherwise(none).alias("card"))


def indexed_files(chunks: DataFrame, language: str | None = None) -> DataFrame:
    c = chunks if language is None else chunks.where(F.col("language") == language)
    return c.groupBy("repo", "branch").agg(F.countDistinct("file_path").alias("n_files"), F.array_sort(F.collect_set("file_path")).alias("paths"))


def file_chunks(chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Chunks of each file by position, at most ``limit``: id, position, preview, and how many the file has. Keys are counted and ranked; texts join those that stay."""
    key = ["repo", "branch", "file_path", "chunk_id"]
    places = chunks.select(*key, "position")
    sizes = places.groupBy(*key[:3]).agg(F.count("*").alias("n_chunks"))
    first = places.withColumn("rank", F.row_number().over(W.partitionBy(*key[:3]).orderBy("position", "chunk_id"))).where(F.col("rank") <= limit)
    found = first.join(sizes, key[:3]).join(chunks.drop("position"), key)
    return found.select("repo", "branch", "file_path", "chunk_id", "language", "position", truncate(F.col("text"), PREVIEW).alias("preview"), "n_chunks", "rank")


def index_stats(files: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, entities and chunks of each slice."""
    kinds = {"n_files": files, "n_entities": entities, "n_chunks": chunks}
    parts = [d.groupBy("repo", "branch").agg(F.count("*").alias("n")).select("repo", "branch", F.lit(k).alias("kind"), "n") for k, d in kinds.items()]
    all_parts = parts[0].union(parts[1]).union(parts[2])
    return all_parts.groupBy("repo", "branch").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])


def index_coverage(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Eligible files that aren't indexed, and indexed ones that aren't eligible (any more)."""
    key = ["repo", "branch", "file_path"]
    ok = files.where(is_supported(F.col("file_path")) & not_ignored(F.col("file_path"))).select(*key).distinct()
    done = chunks.select(*key).distinct()
    return ok.join(done, key, "left_anti").withColumn("state", F.lit("missing")).union(done.join(ok, key, "left_anti").withColumn("state", F.lit("extra")))


def repo_catalog(raw: DataFrame) -> DataFrame:
    """The repo catalogue from JSON rows: seven fields, owner unnested, default branch ``main`` where the key is absent."""
    return raw.select("full_name", "name", F.col("owner.login").alias("owner"), F.coalesce("default_branch", F.lit("main")).alias("default_branch"), "private", "html_url", "description")
