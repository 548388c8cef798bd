"""DuckDB statements for the operators that SQL can express."""

from bidlens.llm.urlrules import RULES

_RULES = ", ".join(f"('{v}', '{r}')" for v, r in RULES)

SQL = {
    "op1_topk_search": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op4_url_filter": f"""
        WITH rules(verdict, rule) AS (VALUES {_RULES}),
        u AS (
            SELECT page_id,
                   CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM pages
        ), p AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM u
        ), parts AS (
            SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, position('/' IN rule)) AS rule_path FROM rules
        ), m AS (
            SELECT p.*, rule, verdict,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS n
            FROM p LEFT JOIN parts ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
    """,
    "op5_chat_rotation": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'),
                       left(coalesce(text, ''), 64), md5(coalesce(text, ''))) - 1 AS pos
            FROM conversations
        ), people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
        s AS (
            SELECT conv_id, perspective, pos // 64 AS part, pos, speaker = perspective AS own,
                   '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                       ELSE 'user name=' || regexp_replace(speaker, '[\s<>|]', '_', 'g') END || chr(10) AS opening,
                   replace(text, '<|im_', '< |im_') || '<|im_end|>' AS body
            FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c
        ), w AS (
            SELECT *, sum(length(opening) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) AS upto FROM s
        )
        SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_trained,
               string_agg(opening || body || chr(10), '' ORDER BY pos) AS text,
               coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(body) - 1 AS BIGINT) || ':' || CAST(upto - 1 AS BIGINT) END, ',' ORDER BY pos), '') AS mask
        FROM w GROUP BY conv_id, perspective, part
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
                   CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
            FROM s WHERE alike
        ), n AS (
            SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike
                AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
            WHERE place <= 5
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op13_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM starts
        ), later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS first FROM windows) WHERE doc_id > first
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM later
        ), lists AS (SELECT doc_id, list(place) AS gone FROM gone GROUP BY doc_id),
        kept AS (
            SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN lists USING (doc_id)
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
        FROM kept
    """,
}
