"""Retrieval for many questions at once: semantic, augmented and hybrid search, fusion, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltloom.functions import text as T
from siltloom.functions.paths import in_mirror
from siltloom.operators.graph import Links, entity_with_relations, links_of, lookup_names, nearest, neighbourhood
from siltloom.operators.postings import Postings, holding, post
from siltloom.operators.vectors import vector_topk
from siltloom.sources.tables import stored

HIT = ("repo", "branch", "file_path", "language", "text", "entity_id", "ast_type", "ast_name", "ast_signature")
FEW_HITS, FEW_CHARACTERS = 6, 4000
#: The highest score of a node that only the graph finds, at a distance of 2 or more.
FAR = 0.3


def search(queries: DataFrame, chunks: DataFrame, limit: int = 6) -> DataFrame:
    """The best chunks of each query with their payload; absent payload is ``unknown`` or empty."""
    top = vector_topk(queries, chunks, limit)
    unknown = ("repo", "branch", "file_path", "language")
    payload = chunks.select("chunk_id", "position", *[F.coalesce(F.col(c), F.lit("unknown" if c in unknown else "")).alias(c) if c not in ("entity_id",) else F.col(c) for c in HIT])
    return top.join(payload, "chunk_id").withColumn("source", F.lit("vector"))


def file_scores(hits: DataFrame) -> DataFrame:
    """A file's score is the sum of its chunks' scores; files are told apart by repo, branch and path."""
    return hits.groupBy("query_id", "repo", "branch", "file_path").agg(F.sum("score").alias("score"))


def top_files(scores: DataFrame, max_files: int = 10) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "repo", "branch", "file_path")
    return scores.withColumn("file_rank", F.row_number().over(order)).where(F.col("file_rank") <= max_files)


def search_augmented(queries: DataFrame, chunks: DataFrame, limit: int = 50, max_files: int = 10, top: DataFrame | None = None) -> DataFrame:
    """All chunks of each query's best files, in order: (query_id, file_rank, repo, branch, file_path, position, chunk_id).

    The best chunks vote for their files; whole files are then read by a join on the file, whose right side has ``max_files`` rows a query. ``top``: the rows of ``vector_topk``, ``limit`` a query or more, where they are known.
    """
    best = vector_topk(queries, chunks, limit) if top is None else top.where(F.col("rank") <= limit)
    hits = best.join(chunks.select("chunk_id", "repo", "branch", "file_path"), "chunk_id")
    best = top_files(file_scores(hits), max_files).drop("score")
    return best.join(chunks.drop("embedding"), ["repo", "branch", "file_path"])


def graph_hits(seeds: DataFrame, nodes: DataFrame, edges: DataFrame | Links, depth: int = 2) -> DataFrame:
    """Neighbours of seed entities: (query_id, key, distance), the smallest one. Edges may be resolved ones or links by name."""
    near = neighbourhood(seeds, edges if isinstance(edges, Links) else links_of(edges), depth)
    return nearest(near).join(nodes.select("id"), "id", "left_semi").withColumnRenamed("id", "key")


def fuse(hits: DataFrame) -> DataFrame:
    """Hits (query_id, key, score, src_rank, source) of several retrievers: the largest score and the first source of each key."""
    return hits.groupBy("query_id", "key").agg(F.max("score").alias("score"), F.min_by("source", "src_rank").alias("source"), F.min("src_rank").alias("src_rank"))


def search_hybrid(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame | Links, limit: int = 12, depth: int = 2, top: DataFrame | None = None) -> DataFrame:
    """Vector, graph and name hits in one ranking: (query_id, key, score, source, rank).

    queries: (query_id, query, vector, repo?, branch?). Scores: a vector hit keeps its cosine, or 0.5 / distance if a neighbour of one is nearer; a node
    found by the graph only has 0.6 / distance; a node whose name stands in the question has at least 0.9. Equal scores: vector, graph, name, then key. ``top``: the rows of ``vector_topk``, 3 * limit a query or more,
    where they are known.

    The graph is searched to distance 1 for all queries. Nodes farther away have 0.3 at most, so that they rank nowhere for a query with ``limit`` keys above that; only the other queries are searched
    for to ``depth``. What may still change there is the source of a node found by name: whether the graph reaches it, too, is asked from its side, as distances are the same both ways.
    """
    best = vector_topk(queries, chunks, 3 * limit) if top is None else top.where(F.col("rank") <= 3 * limit)
    hits = stored(best.join(chunks.select("chunk_id", "entity_id", "repo", "branch", "file_path", "position"), "chunk_id"))
    place = F.concat_ws(":", "repo", "branch", "file_path", F.col("position").cast("string"))
    vector = hits.select("query_id", F.coalesce("entity_id", place).alias("key"), "score", F.lit(0).alias("src_rank"), F.lit("vector").alias("source"))
    seeds = hits.where("entity_id is not null").select("query_id", F.col("entity_id").alias("id")).distinct()
    known = vector.select("query_id", "key").distinct().withColumn("seen", F.lit(True))
    scored = lambda near: near.join(known, ["query_id", "key"], "left").select("query_id", "key", (F.when(F.col("seen"), 0.5).otherwise(0.6) / F.col("distance")).alias("score"), F.lit(1).alias("src_rank"), F.lit("graph").alias("source"))
    asked = queries.select("query_id", "repo", "branch", F.explode(T.name_candidates(F.col("query"))).alias("name"))
    named = lookup_names(asked, nodes, 3).select("query_id", F.col("id").alias("key"), F.lit(0.9).alias("score"), F.lit(2).alias("src_rank"), F.lit("keyword").alias("source"))
    edges = edges if isinstance(edges, Links) else links_of(edges)
    near = graph_hits(seeds, nodes, edges, 1)
    if depth > 1:
        near, named = stored(near), stored(named)
        above = fuse(vector.union(scored(near)).union(named)).where(F.round("score", 9) > FAR)
        settled = stored(above.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("query_id"))
        far = graph_hits(seeds.join(settled, "query_id", "left_anti"), nodes, edges, depth)
        keys = stored(named.join(settled, "query_id", "left_semi").select("query_id", "key").distinct().join(known, ["query_id", "key"], "left_anti"))
        around = neighbourhood(keys.select(F.lit(0).alias("query_id"), F.col("key").alias("id")).distinct(), edges, depth).select(F.col("seed_id").alias("key"), "id")
        both = keys.join(around, "key").join(seeds, ["query_id", "id"], "left_semi").select("query_id", "key", F.lit(depth).alias("distance"))
        near = near.join(settled, "query_id", "left_semi").select("query_id", "key", "distance").union(far.select("query_id", "key", "distance")).union(both)
        near = near.groupBy("query_id", "key").agg(F.min("distance").alias("distance"))
    graph = scored(near)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "src_rank", "key")
    ranked = fuse(vector.union(graph).union(named)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("query_id", "key", "score", "source", "rank")


def entity(names: DataFrame, nodes: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """The first node (by file path) of each (query_id, name, repo?, branch?) with its relations."""
    first = lookup_names(names, nodes, 1).select("query_id", "id")
    return first.join(entity_with_relations(first.select("id"), nodes, edges), "id")


def merge_contexts(hits: DataFrame) -> DataFrame:
    """Hits (query_id, stage, rank, file_path, text, score, source, ...) of all stages: those of one file whose texts begin alike are one.

    The first (by stage, then rank) gives the payload, the best score stays, the sources are joined with ``+`` in order.
    """
    at = F.struct("stage", "rank")
    rest = [c for c in hits.columns if c not in ("query_id", "score", "source")]
    tags = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("stage", "rank", "source"))), lambda x: x["source"])), "+")
    merged = hits.groupBy("query_id", "file_path", F.substring("text", 1, T.KEY).alias("__k")).agg(F.min_by(F.struct(*rest), at).alias("r"), F.max("score").alias("score"), tags.alias("source"))
    out = merged.select("query_id", "r.*", "score", "source").withColumnRenamed("rank", "stage_rank")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("stage", "stage_rank", "file_path")))


def needs_fallback(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, n_chars, scarce): under six hits, or texts (joined by a blank) under 4,000 characters; queries without a hit are scarce."""
    sums = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s"))
    d = queries.select("query_id").distinct().join(sums, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"), F.coalesce(F.col("s") + F.col("n") - 1, F.lit(0)).alias("n_chars"))
    return d.withColumn("scarce", (F.col("n_hits") < FEW_HITS) | (F.col("n_chars") < FEW_CHARACTERS))


def file_postings(files: DataFrame) -> Postings:
    """The trigram index of the mirror's files (repo, branch, file_path, content), in lower case; made once, for any number of scans."""
    return post(_scanned(files), ("repo",))


def _scanned(files: DataFrame) -> DataFrame:
    """A file's number is a hash of its place."""
    return files.where(in_mirror(F.col("file_path"))).select("repo", F.xxhash64("repo", "branch", "file_path").alias("doc"), F.lower("content").alias("text"))


def keyword_scan(queries: DataFrame, files: DataFrame, max_files: int = 20, max_chars: int | None = None, postings: Postings | None = None) -> DataFrame:
    """Files of a query's repo and branch that hold any of its keywords, in any case: the first ``max_files`` by path, contents cut with a notice.

    queries: (query_id, repo, branch, keywords). With ``postings`` of the files a content is read only where its trigrams say that it may hold a keyword; without, contents are scanned once for each
    distinct keyword of their repo. Files are ranked by their places; contents join last.
    """
    q = queries.select("query_id", "repo", F.col("branch").alias("b"), F.explode(F.expr("array_distinct(transform(filter(keywords, k -> k <> ''), k -> lower(k)))")).alias("pattern"))
    places = files.where(in_mirror(F.col("file_path"))).select("repo", "branch", "file_path", F.xxhash64("repo", "branch", "file_path").alias("doc"))
    words = q.select("repo", "pattern").distinct()
    texts = _scanned(files)
    met = holding(words, postings, texts) if postings else words.join(texts, "repo").where(F.contains("text", "pattern")).select("repo", "pattern", "doc")
    found = q.join(met, ["repo", "pattern"]).select("query_id", "repo", "b", "doc").distinct().join(places, ["repo", "doc"]).where("b is null or b = branch")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("file_path"))).where(F.col("rank") <= max_files)
    found = found.drop("b", "doc").join(files.select("repo", "branch", "file_path", "content"), ["repo", "branch", "file_path"])
    if max_chars is not None:
        notice = F.concat(F.lit("\n\n-- ... archivo truncado ("), F.length("content").cast("string"), F.lit(" chars originales) ... --\n"))
        found = found.withColumn("content", T.truncate(F.col("content"), max_chars, notice))
    return found.select("query_id", "repo", "branch", "file_path", "content", "rank")


def class_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """Class names in questions (query_id, query, repo, branch): their entity with score 1.0, and its first five relation targets with 0.95, if they have code.

    Until the last join nodes go without their texts: of the code only whether there is any.
    """
    slim = nodes.select("id", "type", "name", "file_path", "repo", "branch", F.when(F.col("code") != "", "1").otherwise("").alias("code"))
    asked = questions.where("repo is not null").select("query_id", "repo", "branch", F.posexplode(T.class_names(F.col("query"))).alias("n", "name"))
    first = entity(asked.drop("n"), slim, edges).where("code <> ''")
    own = first.select("query_id", "id", F.lit(1.0).alias("score"), F.lit("entity").alias("source"))
    targets = first.select("query_id", F.col("repo"), F.col("branch"), F.explode(F.slice(F.filter("relations", lambda r: r["target_name"] != ""), 1, 5)).alias("r")).select("query_id", "repo", "branch", F.col("r.target_name").alias("name"))
    more = lookup_names(targets, slim, 1).where("code <> ''").select("query_id", "id", F.lit(0.95).alias("score"), F.lit("relation").alias("source"))
    best = own.union(more).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max_by("source", "score").alias("source"))
    return best.join(nodes, "id")


def class_files(questions: DataFrame, nodes: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Class names without an entity: the first two indexed paths that contain the name, as whole files with score 1.0.

    Names meet paths by a trigram index of the paths, once for each name asked of a repo, not for each question.
    """
    asked = questions.where("repo is not null").select("query_id", "repo", "branch", F.explode(T.class_names(F.col("query"))).alias("name"))
    found = lookup_names(asked, nodes, 1).select("query_id", "name")
    missing = asked.join(found, ["query_id", "name"], "left_anti")
    paths = chunks.select("repo", F.col("branch").alias("file_branch"), "file_path").distinct()
    placed = stored(paths.withColumn("doc", F.xxhash64("repo", "file_branch", "file_path")))
    met = holding(missing.select("repo", F.col("name").alias("pattern")), post(placed, ("repo",), text="file_path"), placed, text="file_path").withColumnRenamed("pattern", "name")
    hit = missing.select("repo", "branch", "name").distinct().join(met, ["repo", "name"]).join(placed, ["repo", "doc"]).where("branch is null or branch = file_branch")
    hit = hit.withColumn("rank", F.row_number().over(W.partitionBy("repo", "branch", "name").orderBy("file_path"))).where("rank <= 2").drop("rank")
    hit = hit.select(F.col("repo").alias("r"), F.col("branch").alias("b"), F.col("name").alias("n"), "file_branch", "file_path")
    placed = missing.join(hit, (F.col("repo") == F.col("r")) & F.col("branch").eqNullSafe(F.col("b")) & (F.col("name") == F.col("n")))
    placed = placed.select("query_id", "repo", F.col("file_branch").alias("branch"), "file_path", "name")
    return placed.join(files.select("repo", "branch", "file_path", "content"), ["repo", "branch", "file_path"]).withColumn("score", F.lit(1.0))


def build_context(hits: DataFrame) -> DataFrame:
    """One text a query of its ranked hits (query_id, rank, ...), as numbered fragments."""
    numbered = hits.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    part = numbered.select("query_id", "n", T.context_fragment(F.col("n")).alias("fragment"))
    return part.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "fragment"))), lambda x: x["fragment"]), "\n\n---\n\n").alias("context"))


def answer_context(questions: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame | Links, files: DataFrame, limit: int = 20, postings: Postings | None = None) -> DataFrame:
    """The full context of questions (query_id, query, vector): augmented files, hybrid hits, classes, and a keyword scan where that is scarce.

    Stages follow each other in this order; whole files have score 0, files of the scan 0.7. Scanned are 15 files a question at most, 12,000 characters each.
    Chunks and nodes are read several times: tables that are costly to derive should be stored first. The best chunks are searched for once, and the first stages' hits stored.
    """
    q = questions.withColumns({"repo": T.first_repo(F.col("query")), "branch": T.first_branch(F.col("query"))})
    shape = lambda df, stage: df.select("query_id", F.lit(stage).alias("stage"), "rank", *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in HIT], "score", "source")
    by = lambda *c: F.row_number().over(W.partitionBy("query_id").orderBy(*c))
    top = stored(vector_topk(q, chunks, max(50, 3 * limit)))
    augmented = search_augmented(q, chunks, 50, top=top).withColumn("rank", by("file_rank", "position")).withColumns({"score": F.lit(0.0), "source": F.lit("augmented")})
    named = nodes.withColumnsRenamed({"code": "text", "type": "ast_type", "name": "ast_name", "signature": "ast_signature"})
    hybrid = search_hybrid(q, chunks, nodes, edges, limit, top=top).join(named.withColumn("entity_id", F.col("id")).withColumnRenamed("id", "key"), "key")
    classes = class_context(q, nodes, edges).withColumn("rank", by(F.desc("score"), "id")).withColumn("entity_id", F.col("id")).withColumnsRenamed({"code": "text", "type": "ast_type", "name": "ast_name", "signature": "ast_signature"})
    whole = class_files(q, nodes, chunks, files).withColumn("rank", by("name", "file_path")).withColumnRenamed("content", "text").withColumn("source", F.lit("fetch"))
    first = stored(merge_contexts(shape(augmented, 0).unionByName(shape(hybrid, 1)).unionByName(shape(classes, 2)).unionByName(shape(whole, 3))))
    scarce = needs_fallback(q, first).where("scarce").select("query_id")
    asked = q.where("repo is not null").join(scarce, "query_id").select("query_id", "repo", "branch", T.keywords(F.col("query")).alias("keywords"))
    scanned = keyword_scan(asked, files, 15, 12000, postings).withColumnRenamed("content", "text").withColumns({"score": F.lit(0.7), "source": F.lit("clone")})
    again = first.drop("rank").withColumnRenamed("stage_rank", "rank").unionByName(shape(scanned, 4))
    return build_context(merge_contexts(again))
