"""Plain SQL with the results of this subpackage's queries, where SQL can state them."""

from __future__ import annotations

_BARE = "regexp_replace(lower(coalesce({0}::VARCHAR, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _bare(column: str) -> str:
    return _BARE.format(column)


_P2 = f"""
WITH n AS (SELECT idx, least({_bare('last_name')}, {_bare('first_name')}) n1, greatest({_bare('last_name')}, {_bare('first_name')}) n2,
                  {_bare('street_name')} s, house_number h, birth_year y, gender g FROM df_a),
k AS (SELECT idx, min(idx) OVER w AS keep, count(*) OVER w AS n FROM n WINDOW w AS (PARTITION BY n1, n2, s, h, y, g))
"""

_P3 = """
WITH RECURSIVE e AS (SELECT DISTINCT idx_a x, idx_b y FROM linkage_indices WHERE idx_a <> idx_b
                     UNION SELECT DISTINCT idx_b, idx_a FROM linkage_indices WHERE idx_a <> idx_b),
v AS (SELECT DISTINCT i FROM (SELECT idx_a i FROM linkage_indices UNION ALL SELECT idx_b FROM linkage_indices) WHERE i IS NOT NULL),
r(i, g) AS (SELECT i, i FROM v UNION SELECT e.y, r.g FROM r JOIN e ON r.i = e.x WHERE e.y > r.g)
SELECT i AS idx, min(g) AS group_idx FROM r GROUP BY i
"""

_P9 = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, substring(text, i + 1, 200) AS x FROM (SELECT doc_id, text, unnest(range(n - 199)) AS i FROM d)),
s AS (SELECT x FROM w GROUP BY x HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN s USING (x)),
r AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
f AS (SELECT doc_id, min(i)::INT AS span_start, (max(i) + 200)::INT AS span_end FROM r GROUP BY doc_id, run)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT keep AS keep_idx, idx AS copy_idx FROM k WHERE idx <> keep",
        "p2_counts": _P2 + "SELECT idx, n AS n_copies FROM k WHERE idx = keep",
        "p3_found": _P3,
        "p9_found": _P9 + "SELECT * FROM f",
        "p9_portion": _P9 + """SELECT o.doc_id, coalesce(g.k, 0) AS n_spans, coalesce(g.c, 0)::BIGINT AS shared_chars, CASE WHEN length(o.text) > 0 THEN coalesce(g.c, 0)::DOUBLE / length(o.text) ELSE 0.0 END AS shared_part
            FROM documents o LEFT JOIN (SELECT doc_id, count(*) AS k, sum(span_end - span_start) AS c FROM f GROUP BY doc_id) g ON o.doc_id = g.doc_id""",
    }
