"""DuckDB SQL for those of the ten operators that SQL can express."""

from __future__ import annotations

from symgraph.llm.secrets import RULES


def _secrets() -> str:
    """Gaps and matches of every rule, with running lengths as starts."""
    quoted = [(i, r, r.pattern.replace("'", "''")) for i, r in enumerate(RULES)]
    per_rule = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS m, "
        f"string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', {r.group}) AS part FROM docs"
        for i, r, p in quoted
    )
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({per_rule}),
    one AS (SELECT doc_id, rank, kind, least, m, g, part, unnest(generate_series(1, len(m))) AS k FROM found WHERE len(m) > 0),
    spans AS (
        SELECT doc_id, rank, kind, length(m[k]) AS n,
               list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
        FROM one WHERE length(part[k]) >= least),
    named AS (SELECT doc_id, rank, kind, start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT)) AS span FROM spans)
    SELECT d.doc_id,
           count(*) FILTER (WHERE kind = 'assign') AS n_assign,
           count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
    FROM docs d LEFT JOIN named n ON d.doc_id = n.doc_id
    GROUP BY d.doc_id"""


EMBEDDINGS = """
    WITH RECURSIVE good AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    link AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(x, y) AS (
        SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
    degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
    SELECT r.x AS vec_id, coalesce(any_value(d.n), 0) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
    FROM reach r LEFT JOIN degree d ON r.x = d.x GROUP BY r.x"""

LM_SCORE = """
    WITH lists AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
    g AS (SELECT doc_id, i, w, lag(w, 1) OVER d AS v, lag(w, 2) OVER d AS u FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    -- How often each n-gram stands in other documents: everywhere less its own.
    c1 AS (SELECT doc_id, w, sum(count(*)) OVER (PARTITION BY w) - count(*) AS c FROM words GROUP BY doc_id, w),
    c2 AS (SELECT doc_id, v, w, sum(count(*)) OVER (PARTITION BY v, w) - count(*) AS c FROM g WHERE i >= 2 GROUP BY doc_id, v, w),
    c3 AS (SELECT doc_id, u, v, w, sum(count(*)) OVER (PARTITION BY u, v, w) - count(*) AS c FROM g WHERE i >= 3 GROUP BY doc_id, u, v, w),
    n AS (SELECT doc_id, len(ws) AS own, (SELECT count(*) FROM words) - len(ws) AS others FROM lists),
    scored AS (
        SELECT g.doc_id, CASE
            WHEN i >= 3 AND t.c > 0 THEN ln(t.c) - ln(bv.c)
            WHEN i >= 2 AND b.c > 0 THEN least(i - 2, 1) * ln(0.4) + ln(b.c) - ln(av.c)
            WHEN a.c > 0 THEN least(i - 1, 2) * ln(0.4) + ln(a.c) - ln(n.others)
            ELSE least(i - 1, 2) * ln(0.4) - ln(n.others + 1) END AS s
        FROM g JOIN n ON g.doc_id = n.doc_id JOIN c1 a ON g.doc_id = a.doc_id AND g.w = a.w LEFT JOIN c1 av ON g.doc_id = av.doc_id AND g.v = av.w
        LEFT JOIN c2 b ON g.doc_id = b.doc_id AND g.v = b.v AND g.w = b.w LEFT JOIN c2 bv ON g.doc_id = bv.doc_id AND g.u = bv.v AND g.v = bv.w
        LEFT JOIN c3 t ON g.doc_id = t.doc_id AND g.u = t.u AND g.v = t.v AND g.w = t.w)
    SELECT n.doc_id, CAST(n.own AS BIGINT) AS n_words, round(coalesce(sum(s), 0.0), 4) AS log_score, round(sum(s) / nullif(n.own, 0), 4) AS mean_log_score
    FROM n LEFT JOIN scored s ON n.doc_id = s.doc_id GROUP BY n.doc_id, n.own"""

EXACT = """
    WITH plain AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS t FROM documents),
    grouped AS (
        SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
               first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
        FROM plain)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped"""

# DuckDB has no crc32: `remainders` is its table, `digits` takes the characters of each id through it.
TRIE = """
    WITH RECURSIVE bits AS (SELECT b AS byte, CAST(b AS UBIGINT) AS r, 0 AS k FROM range(256) t(b)
        UNION ALL SELECT byte, CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS UBIGINT)) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
    remainders AS (SELECT list(r ORDER BY byte) AS t FROM bits WHERE k = 8),
    digits AS (
        SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, CAST(4294967295 AS UBIGINT) AS c, 1 AS k FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
        UNION ALL SELECT conv_id, s, xor(t[CAST(xor(c & 255, CAST(ascii(s[k]) AS UBIGINT)) AS BIGINT) + 1], c >> 8), k + 1 FROM digits, remainders WHERE k <= length(s)),
    forks AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(xor(c, CAST(4294967295 AS UBIGINT)) % 9 AS BIGINT) AS h FROM digits WHERE k = length(s) + 1),
    turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    rebuilt AS (
        SELECT f.conv_id, 0 AS part, t.pos, t.role, t.text FROM forks f JOIN turns t ON t.conv_id = f.base AND t.pos <= f.h
        UNION ALL SELECT f.conv_id, 1, t.pos, t.role, t.text FROM forks f JOIN turns t ON t.conv_id = f.conv_id AND t.pos > f.h),
    lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS turns FROM rebuilt GROUP BY conv_id),
    whole AS (SELECT f.conv_id, coalesce(turns, []) AS turns, coalesce(len(turns), 0) AS size FROM forks f LEFT JOIN lists l ON f.conv_id = l.conv_id),
    prefixes AS (SELECT conv_id, size, d AS depth, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes, CAST(turns[1:d] AS VARCHAR) || d AS path
        FROM (SELECT *, unnest(range(size + 1)) AS d FROM whole)),
    placed AS (SELECT *, min(conv_id) OVER (PARTITION BY path) AS node FROM prefixes),
    nodes AS (SELECT node, depth, any_value(bytes) AS bytes, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends FROM placed GROUP BY node, depth),
    up AS (SELECT n.node, n.depth, p.node AS parent FROM nodes n JOIN placed p ON p.conv_id = n.node AND p.depth = n.depth - 1),
    kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
    below AS (SELECT a.node, a.depth, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
        FROM nodes n LEFT JOIN kids k ON n.node = k.node AND n.depth = k.depth JOIN placed a ON a.conv_id = n.node AND a.depth <= n.depth GROUP BY a.node, a.depth)
    SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, u.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
           CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n JOIN below b ON n.node = b.node AND n.depth = b.depth LEFT JOIN up u ON n.node = u.node AND n.depth = u.depth
    LEFT JOIN kids k ON n.node = k.node AND n.depth = k.depth"""

ORACLES: dict[str, str] = {"op1_lm_score": LM_SCORE, "op2_secret_scan": _secrets(), "op4_embeddings": EMBEDDINGS, "op12_exact_dedup": EXACT, "op13_prefix_trie": TRIE}
