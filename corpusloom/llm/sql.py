"""SQL that gives the same rows as a query, where SQL can."""

from __future__ import annotations


def _round(k: int) -> str:
    """One round of k-means: every vector's nearest centroid, then the floor of every component's mean."""
    return f"""
near{k} AS MATERIALIZED (
    SELECT row, any_value(v) AS v, min({{'d': away, 'k': k}}) AS m
    FROM (SELECT row, v, k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS away FROM kept, centre{k})
    GROUP BY row
),
mean{k} AS (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
    FROM (SELECT m.k AS k, j, sum(v[j]) AS s, count(*) AS n FROM near{k}, range(1, 65) AS t(j) GROUP BY ALL)
    GROUP BY k
),
centre{k + 1} AS MATERIALIZED (
    SELECT centre{k}.k, coalesce(mean{k}.c, centre{k}.c) AS c FROM centre{k} LEFT JOIN mean{k} USING (k)
)"""


#: Every item of which a document holds at least 0.8 of the distinct runs of five words (or all of a shorter item's words).
CONTAINMENT = r"""
WITH item AS MATERIALIZED (
    SELECT item_id, w, least(5, len(w)) AS width
    FROM (
        SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
        FROM benchmark WHERE item_id IS NOT NULL
    )
),
wanted AS MATERIALIZED (
    SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS shingle
    FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM item WHERE width > 0)
),
sized AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id),
doc AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL
),
held AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + width - 1], ' ') AS shingle
    FROM (
        SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM doc, (SELECT DISTINCT width FROM item WHERE width > 0) AS widths
    )
),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM held JOIN wanted USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM shared JOIN sized USING (item_id)
WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""

CLUSTERS = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
centre0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c
    FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 8)
),{",".join(_round(k) for k in range(11))}
SELECT kept.vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near10 JOIN kept USING (row) JOIN centre10 ON centre10.k = m.k
"""
