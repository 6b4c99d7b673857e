"""The views of fixtures.py in DuckDB's SQL, for the oracle."""

from __future__ import annotations

_TITLE = r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,11})"
_STAMP = "%Y-%m-%dT%H:%M:%SZ"

VIEWS = {
    "threads": rf"""
      SELECT d.doc_id AS id, 1::BIGINT AS repo_id, d.doc_id + 100 AS number, CASE WHEN d.doc_id % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS kind,
        CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'closed' ELSE 'open' END AS state,
        regexp_replace(regexp_extract(text, '{_TITLE}', 1), '[\x20\x09-\x0D]+', ' ', 'g') AS title,
        CASE WHEN d.doc_id % 20 = 0 THEN 'Fixes #' || (d.doc_id + 99) || ' ' || text WHEN d.doc_id % 20 = 10 THEN text || ' Fixes #' || (d.doc_id + 99) ELSE text END AS body,
        source AS author_login, 'User' AS author_type, 'https://example.test/t/' || (d.doc_id + 100) AS html_url, '[{{"name":"' || lang || '"}}]' AS labels_json, lang,
        CASE WHEN d.doc_id % 7 <> 0 THEN '2024-02-' || lpad((1 + d.doc_id % 28)::VARCHAR, 2, '0') || 'T00:00:00Z' END AS updated_at_gh,
        '2024-01-' || lpad((1 + d.doc_id % 31)::VARCHAR, 2, '0') || 'T00:00:00Z' AS updated_at, CASE WHEN d.doc_id % 11 = 0 THEN '2024-03-01T00:00:00Z' END AS closed_at_local
      FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "vectors": "SELECT vec_id AS thread_id, 'm' || (label % 2) AS model, embedding::DOUBLE[] AS vector FROM embeddings",
    "docs": r"""
      SELECT t.id AS thread_id, t.title, t.body, t.updated_at,
        '# ' || title || CASE WHEN trim(body) <> '' THEN chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE '' END || chr(10) || chr(10) || 'Labels: ' || lang || coalesce(c.lines, '') AS raw_text,
        trim(regexp_replace(lower(title || ' ' || body || ' ' || lang || coalesce(c.parts, '')), '\s+', ' ', 'g')) AS dedupe_text
      FROM threads t LEFT JOIN (
        SELECT conv_id, string_agg(CASE WHEN trim(text) <> '' THEN chr(10) || chr(10) || role || ': ' || regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END, '' ORDER BY turn) AS lines, string_agg(' ' || text, '' ORDER BY turn) AS parts
        FROM conversations WHERE role <> 'system' GROUP BY conv_id) c ON t.id = c.conv_id""",
    "runs": """
      SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'sync' WHEN 'signup' THEN 'embedding' WHEN 'purchase' THEN 'cluster' WHEN 'error' THEN 'sync' ELSE 'summary' END AS kind, user_id % 5 AS repo_id,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS finished_at FROM events""",
    "parts": """
      SELECT p_partkey AS id, p_partkey AS number, CASE WHEN p_size % 2 = 0 THEN 'issue' ELSE 'pull_request' END AS kind, CASE WHEN p_size % 7 = 0 THEN 'closed' ELSE 'open' END AS state, p_name AS title, p_type AS body,
        '2024-01-' || lpad((1 + p_partkey % 31)::VARCHAR, 2, '0') || 'T00:00:00Z' AS updated_at FROM part""",
    "lines": "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus) = 1",
    "members": """
      SELECT l_orderkey AS cluster_id, l_partkey AS thread_id, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1 THEN 'canonical' ELSE 'related' END AS role,
        CASE WHEN l_returnflag = 'R' THEN 'excluded' ELSE 'active' END AS state, l_discount AS score FROM lines""",
    "groups": f"""
      SELECT o_orderkey AS id, o_custkey % 5 AS repo_id, 's' || o_orderkey AS stable_slug, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' WHEN 'P' THEN 'merged' END AS status, m.thread_id AS lead,
        'Cluster ' || o_orderkey AS title, strftime(o_orderdate, '{_STAMP}') AS updated_at, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '{_STAMP}') END AS closed_at
      FROM orders LEFT JOIN members m ON m.cluster_id = o_orderkey AND m.role = 'canonical'""",
    "closures": "SELECT o_orderkey AS cluster_id, '2024-05-01T00:00:00Z' AS updated_at FROM orders WHERE o_orderkey % 50 = 0",
    "overrides": """
      SELECT l_orderkey AS cluster_id, l_partkey AS thread_id, l_orderkey * 10000000 + l_partkey AS id,
        CASE WHEN l_linenumber = 7 THEN 'exclude' WHEN l_linenumber = 2 THEN 'canonical' WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 'include' END AS action FROM lines""",
    "raw": f"""
      SELECT o_orderkey AS id, 1 + o_orderkey % 2 AS run, s.rep, s.member_count, strftime(o_orderdate, '{_STAMP}') AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'closed' END AS close_reason
      FROM orders JOIN (SELECT l_orderkey, count(*) AS member_count, min(l_partkey) AS rep FROM lines GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey""",
    "visible": """
      SELECT m.*, g.repo_id FROM members m JOIN groups g ON g.id = m.cluster_id JOIN parts t ON t.id = m.thread_id AND t.state = 'open'
      WHERE m.role = 'canonical' OR NOT EXISTS (SELECT 1 FROM members o JOIN groups h ON h.id = o.cluster_id WHERE o.thread_id = m.thread_id AND o.cluster_id <> m.cluster_id AND o.state = 'active' AND o.role = 'canonical'
        AND h.repo_id = g.repo_id AND h.status = 'active' AND h.closed_at IS NULL)""",
    "keyed": """
      SELECT conv_id * 1000 + turn AS id, conv_id AS thread_id, CASE WHEN turn % 2 = 1 THEN 'llm_key_summary' ELSE 'llm_key_3line' END AS kind, text AS key_text, lpad(turn::VARCHAR, 6, '0') AS created_at
      FROM conversations WHERE role = 'assistant'""",
    "sides": r"SELECT v.thread_id, v.vector, t.number, t.kind, list_distinct(regexp_extract_all(lower(t.title), '[A-Za-z0-9]{4,}')) AS tokens FROM vectors v JOIN threads t ON t.id = v.thread_id AND t.state = 'open' AND t.closed_at_local IS NULL",
    "pairs": """
      SELECT a.thread_id AS left_id, b.thread_id AS right_id, list_cosine_similarity(a.vector, b.vector) AS score, a.kind = b.kind AS same,
        CASE WHEN least(len(a.tokens), len(b.tokens)) = 0 THEN 0 ELSE len(list_intersect(a.tokens, b.tokens))::DOUBLE / least(len(a.tokens), len(b.tokens)) END AS titled
      FROM sides a JOIN sides b ON a.thread_id < b.thread_id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.2""",
    "near": "SELECT left_id, right_id, score FROM pairs WHERE (score >= 0.35 OR titled >= 0.18) AND (same OR score >= 0.30)",
    "refs": r"""
      SELECT t.id, t.number, t.number - 1 AS ref_number, strlen(substr(t.body, 1, strpos(t.body, '#' || (t.number - 1)) - 1)) <= 240 AS early_body FROM threads t WHERE t.id % 10 = 0""",
    "ref_edges": """
      SELECT DISTINCT least(a.thread_id, b.thread_id) AS left_id, greatest(a.thread_id, b.thread_id) AS right_id, 0.94::DOUBLE AS score
      FROM refs r JOIN sides a ON a.thread_id = r.id JOIN sides b ON b.number = r.ref_number
      WHERE r.early_body OR (least(len(a.tokens), len(b.tokens)) > 0 AND len(list_intersect(a.tokens, b.tokens))::DOUBLE / least(len(a.tokens), len(b.tokens)) >= 0.18)""",
    "all_edges": "SELECT left_id, right_id, max(score) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM ref_edges) GROUP BY ALL",
    "best": """
      SELECT DISTINCT left_id, right_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS nth FROM (
          SELECT left_id, right_id, score, left_id AS node, right_id AS other FROM all_edges UNION ALL SELECT left_id, right_id, score, right_id, left_id FROM all_edges)) WHERE nth <= 4""",
}
#: What each view reads besides the driver's tables.
NEEDS = {
    "docs": ["threads"], "members": ["lines"], "groups": ["members"], "overrides": ["lines"], "raw": ["lines"], "visible": ["members", "groups", "parts"], "sides": ["vectors", "threads"], "pairs": ["sides"], "near": ["pairs"],
    "refs": ["threads"], "ref_edges": ["refs", "sides"], "all_edges": ["near", "ref_edges"], "best": ["all_edges"],
}


def sql(select: str, *views: str, recursive: str = "") -> str:
    """A statement over some views; recursive: further common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in NEEDS.get(name, []):
                add(other)
            order.append(name)

    for name in views:
        add(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}" if parts else select
