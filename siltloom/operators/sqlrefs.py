"""References to SQL files: resolution by path candidates, and inlining into Java chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltloom.functions.paths import basename, dirname, is_sql
from siltloom.functions.text import SQL_LIMIT, sql_refs, truncate

# Where a reference is looked for after the file's own folder, in order.
ROOTS = ("src/main/resources/", "src/test/resources/", "resources/", "")


def references(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, repo, branch, file_path, occurrence, ref): each quoted *.sql name in text order."""
    return chunks.select(*key, "repo", "branch", "file_path", F.posexplode(sql_refs(F.col("text"))).alias("occurrence", "ref"))


def _candidates(path: Column, ref: Column) -> Column:
    own = F.when(dirname(path) == "", ref).otherwise(F.concat(dirname(path), F.lit("/"), ref))
    return F.array(F.replace(own, F.lit("\\"), F.lit("/")), *[F.concat(F.lit(r), ref) for r in ROOTS])


def resolve_sql_refs(refs: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """``refs`` that lead to a file, with ``resolved``: the first candidate path that exists in the slice, else the first path with the same base name.

    References are made distinct by file and name first; every tier is an equi-join on (repo, branch, path).
    """
    paths = files.select("repo", "branch", F.col("file_path").alias("path")).distinct()
    asked = refs.select("repo", "branch", "file_path", "ref").distinct()
    tried = asked.select("*", F.posexplode(_candidates(F.col("file_path"), F.col("ref"))).alias("tier", "path"))
    exact = tried.join(paths, ["repo", "branch", "path"])
    names = paths.groupBy("repo", "branch", basename(F.col("path")).alias("name")).agg(F.min("path").alias("path"))
    loose = asked.withColumn("name", basename(F.col("ref"))).join(names, ["repo", "branch", "name"]).select("repo", "branch", "path", "file_path", "ref", F.lit(len(ROOTS) + 1).alias("tier"))
    found = exact.select("repo", "branch", "path", "file_path", "ref", "tier").union(loose).groupBy("repo", "branch", "file_path", "ref").agg(F.min_by("path", F.struct("tier", "path")).alias("resolved"))
    return refs.join(found, ["repo", "branch", "file_path", "ref"])


def inline_sql(chunks: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """``chunks`` with each referenced SQL file appended to text and embed_text, in the order of the references, repeats included.

    ``key`` identifies a chunk. Blank files are skipped, contents over 6,000 characters are cut with a notice. Only chunks with a reference take part in the joins.
    """
    some = chunks.where(F.size(sql_refs(F.col("text"))) > 0)
    rest = chunks.where(~F.coalesce(F.size(sql_refs(F.col("text"))) > 0, F.lit(False)))
    sql = files.where(is_sql(F.col("file_path")) & F.col("content").rlike(r"\S"))
    notice = F.concat(F.lit("\n-- ... SQL truncado ("), F.length("content").cast("string"), F.lit(" chars originales) ... --\n"))
    bodies = sql.select("repo", "branch", F.col("file_path").alias("resolved"), truncate(F.col("content"), SQL_LIMIT, notice).alias("body"))
    hits = resolve_sql_refs(references(some, key), files, key).join(bodies, ["repo", "branch", "resolved"])
    part = F.concat(F.lit("\n\n-- Referenced SQL: "), F.col("resolved"), F.lit(" --\n"), F.col("body"))
    added = hits.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("occurrence", part.alias("part")))), lambda x: x["part"]), "").alias("__added"))
    out = some.join(added, key, "left")
    plus = lambda c: F.concat(F.col(c), F.coalesce("__added", F.lit("")))
    return out.withColumns({c: plus(c) for c in ("text", "embed_text") if c in chunks.columns}).select(*chunks.columns).unionByName(rest)
