"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
#: Pairs (v, root): the smallest vertex that v reaches over the table links (a, b), which holds each link in both directions.
_COMPONENTS = "reach(v, r) AS (SELECT v, v FROM vertices UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a), roots AS (SELECT v, min(r) AS root FROM reach GROUP BY v)"

PIVOTS = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fine AS (SELECT * FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
vertices AS (SELECT vec_id AS v FROM e), {_COMPONENTS}
SELECT v AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, v = root AS kept FROM roots LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON v = a
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE_WORDS}) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""

_WORD, _BETWEEN = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'", r"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OVERLAPS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_ASCII}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_ASCII}, {_WORD}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN windows USING (n, k)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id),
stretches AS (SELECT doc_id, min(p) AS p, max(p) AS q FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM words) GROUP BY doc_id, g),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(text, {_WORD}), lambda x: length(x)) AS r, list_transform(regexp_extract_all(text, {_BETWEEN}), lambda x: length(x)) AS s,
    CASE WHEN regexp_matches(text, '^' || {_BETWEEN}) THEN 1 ELSE 0 END AS lead FROM d),
hits AS (SELECT doc_id, string_agg((coalesce(list_sum(r[1:p - 1]), 0) + coalesce(list_sum(s[1:p - 1 + lead]), 0)) || ':' || (coalesce(list_sum(r[1:q]), 0) + coalesce(list_sum(s[1:q - 1 + lead]), 0)), ',' ORDER BY p) AS hits
    FROM stretches JOIN raw USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated, coalesce(hits, '') AS hits
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN hits USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII}, {_SPACE_WORDS}) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_in AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS m FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
vertices AS (SELECT doc_id AS v FROM d), {_COMPONENTS}
SELECT v AS doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, v = root AS kept FROM roots LEFT JOIN sizes ON v = doc_id
"""



def _clusters(rounds: int = 5) -> str:
    """k rows, then in turn assignments a0, a1, ... to centroids c0, c1, ... and the floors of their means."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - m.x[i]) * (k.x[i] - m.x[i])))"
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda y: CAST(floor(256 * y) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT x, sha256('2:' || vec_id) AS h FROM k) QUALIFY row_number() OVER (ORDER BY h, x) <= 40)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.vec_id, k.x, m.c, CAST({gap} AS BIGINT) AS d FROM k CROSS JOIN c{r} m) GROUP BY vec_id)")
        means = f"SELECT c, list(v ORDER BY i) AS x FROM (SELECT c, i, CAST((s - (s % n + n) % n) // n AS BIGINT) AS v FROM (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY c, i)) GROUP BY c"
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.x, m.x) AS x FROM c{r} m LEFT JOIN ({means}) n USING (c))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} m USING (c)"
    )


ORACLES = {"op13_threshold_algorithm": _clusters(), "op3_pivot_permutations": PIVOTS, "op7_prefix_suffix_trees": SUBSTRINGS, "op8_aho_corasick": OVERLAPS, "op9_fast_similarity_sketch": NEAR}
