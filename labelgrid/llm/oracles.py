"""SQL for the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .urls import DAMPING, ITERATIONS, THRESHOLD

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_filter(steps: int = ITERATIONS) -> str:
    """Rules, seeds, and the iterations of both propagations, one table a step."""
    parts = [r"""
WITH r(rule, verdict, domain, prefix) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages),
f AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict FROM u LEFT JOIN r ON (u.host = r.domain OR ends_with(u.host, '.' || r.domain)) AND starts_with(u.path, r.prefix) QUALIFY row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule) = 1),
c AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b FROM f GROUP BY host),
z AS (SELECT 'trust' AS side, host FROM c WHERE 2 * a > n UNION ALL SELECT 'distrust', host FROM c WHERE 2 * b > n),
s0 AS (SELECT side, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY side) AS score FROM z),
l AS (SELECT host, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dest FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]+)', 1)) AS t FROM u)),
e AS (SELECT host AS a, dest AS b, CAST(count(*) AS DOUBLE) AS w FROM l WHERE host <> '' AND host <> dest GROUP BY 1, 2),
d AS (SELECT 'trust' AS side, a AS src, b AS dst, w FROM e UNION ALL SELECT 'distrust', b, a, w FROM e),
t AS (SELECT side, src, dst, w / sum(w) OVER (PARTITION BY side, src) AS part FROM d)"""]
    for i in range(1, steps + 1):
        parts.append(f"m{i} AS (SELECT t.side, dst AS host, sum(score * part) AS got FROM t JOIN s{i - 1} s ON s.side = t.side AND s.host = t.src GROUP BY 1, 2)")
        parts.append(f"s{i} AS (SELECT side, host, sum(x) AS score FROM (SELECT side, host, {DAMPING}::DOUBLE * got AS x FROM m{i} UNION ALL SELECT s0.side, s0.host, s0.score * (1 - {DAMPING}::DOUBLE * coalesce(q.total, 0)) FROM s0 LEFT JOIN (SELECT side, sum(got) AS total FROM m{i} GROUP BY 1) q ON q.side = s0.side) GROUP BY 1, 2)")
    parts.append(f"g AS (SELECT host, coalesce(sum(score) FILTER (WHERE side = 'distrust'), 0) / sum(score) > {THRESHOLD} AS bad FROM s{steps} GROUP BY host HAVING sum(score) > 0)")
    return ",\n".join(parts) + "\nSELECT page_id, f.host, path, rule, coalesce(verdict, CASE WHEN g.bad THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN g ON g.host = f.host"


OP2 = _url_filter()

OP3 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS l FROM documents),
k AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS s FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 12)) AS i FROM w WHERE len(l) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
r AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM k JOIN f ON f.s = k.s WHERE first < doc_id), (SELECT unnest(generate_series(0, 12)) AS j)),
p AS (SELECT doc_id, unnest(l) AS word, unnest(generate_series(1, len(l))) AS p FROM w WHERE len(l) > 0),
o AS (SELECT p.doc_id, count(r.p) AS gone, string_agg(CASE WHEN r.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.p GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS l FROM documents),
k AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS s FROM (SELECT doc_id, l, unnest(generate_series(1, greatest(len(l) - 3, 1))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM k a JOIN k b ON b.s = a.s AND b.doc_id <> a.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS o FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.o)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(o) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.id = w.doc_id GROUP BY 1, 2
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""
