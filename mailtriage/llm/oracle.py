"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from mailtriage.llm.url_filter import BLOCK_LIST, RULES


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


_ENTRIES = _values(
    [(*rule.partition("/")[::2], verdict) for rule, verdict in RULES]
    + [(*entry.partition("/")[::2], "listed") for entry in BLOCK_LIST]
)



def _clusters(k: int, rounds: int) -> str:
    """Every vector against every centroid, round by round."""
    parts = [
        """kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(vector) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (
    SELECT f.k, v.i, v.x FROM v JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT {k}
    ) f USING (vec_id)
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
    SELECT vec_id, k, d FROM (
        SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d
        FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.k
    ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM c{r} c LEFT JOIN (
        SELECT a.k, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} a USING (vec_id) GROUP BY a.k, v.i
    ) m ON m.k = c.k AND m.i = c.i
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.k::INT AS cluster, a.d AS distance,
       (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, s.centroid_sha256
FROM a{rounds} a JOIN (
    SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k
) s USING (k)
"""


ORACLE: dict[str, str] = {
    "op11_prefix_trie": r"""
WITH own AS MATERIALIZED (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
                                                                           lambda x: ascii(x)::BIGINT)),
                           lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
                                                    lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 9 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
rebuilt AS MATERIALIZED (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
    FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
),
prefixes AS (
    SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns, len(turns) AS n FROM rebuilt
),
nodes AS MATERIALIZED (
    SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY ALL
),
children AS MATERIALIZED (
    SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
),
joined AS MATERIALIZED (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children,
           CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END AS saved
    FROM nodes n LEFT JOIN children c USING (path)
),
sums AS (
    SELECT path[1:up] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM joined) GROUP BY ALL
)
SELECT j.conv_id, j.depth, p.conv_id AS parent_conv_id, j.n_convs, j.n_children, s.n_leaves, s.saved_tokens, j.ends_sha256
FROM joined j JOIN sums s USING (path) LEFT JOIN nodes p ON j.depth > 0 AND p.path = j.path[1:j.depth - 1]
""",
    "op12_centroids": _clusters(40, 5),
    "op1_ngram_jaccard": r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[]
        ELSE list_distinct(list_transform(range(1, greatest(2, len(words) - 3)),
                                          lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
    FROM texts
),
held AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r USING (doc_id)
GROUP BY s.doc_id, s.shingles
""",
    "op9_exact_dedup": r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM rows
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""",
    "op6_url_filter": rf"""
WITH entries(host, path, verdict) AS (VALUES {_ENTRIES}),
urls AS (
    SELECT page_id, regexp_replace(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END,
                                   '[?#].*$', '', 's') AS rest
    FROM pages
),
split AS (
    SELECT page_id, lower(regexp_extract(rest, '^[^/]*', 0)) AS host,
           CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
    FROM urls
),
fitting AS (
    SELECT s.page_id, e.host || '/' || e.path AS entry, e.verdict
    FROM split s JOIN entries e
      ON (s.host = e.host OR s.host LIKE '%.' || e.host) AND starts_with(s.path, '/' || e.path)
),
judged AS (
    SELECT page_id, arg_max(entry, length(entry)) FILTER (verdict <> 'listed') AS rule,
           arg_max(verdict, length(entry)) FILTER (verdict <> 'listed') AS verdict,
           count(*) FILTER (verdict = 'listed') > 0 AS listed
    FROM fitting GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, j.rule,
       coalesce(j.verdict, CASE WHEN j.listed THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN judged j USING (page_id)
""",
}
