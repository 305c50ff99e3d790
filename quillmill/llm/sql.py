"""What SQL can say of the operators' results, for DuckDB over the driver's tables.

Each follows the contract and not the operator's method: all windows are compared as words, all pairs that share a shingle.
"""

from __future__ import annotations

from quillmill.llm.secrets import ACCESS, ASSIGN, ASSIGN_VALUE, HEX, RANDOM, WIDE_OWNERS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_DOCS = "SELECT row_number() OVER () AS r, * FROM documents"

DECONTAMINATE = rf"""
WITH d AS (SELECT r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM ({_DOCS})),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM d, (SELECT DISTINCT size FROM g)),
h AS (SELECT p.r, i, g.size, item FROM p JOIN g ON g.size = p.size AND array_to_string(list_slice(w, i, i + p.size - 1), ' ') = gram),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS x FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM ({_DOCS})),
p AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 34, 0) + 1)) AS i FROM d)),
t AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS pos FROM p JOIN t USING (g)),
n AS (SELECT r, count(*) AS n_removed FROM x GROUP BY r),
k AS (SELECT r, sha256(string_agg(word, ' ' ORDER BY pos)) AS kept_sha256 FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) y ANTI JOIN x USING (r, pos) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: str, place: int, pattern: str) -> str:
    return f"SELECT r, '{kind}' AS kind, {place} AS place, regexp_extract_all(t, {_quoted(pattern)}) AS hits, regexp_split_to_array(t, {_quoted(pattern)}) AS gaps FROM d WHERE regexp_matches(t, {_quoted(pattern)})"


SECRETS = f"""
WITH d AS (SELECT r, doc_id, source, coalesce(text, '') AS t FROM ({_DOCS})),
f AS ({" UNION ALL ".join([_found("assign", 0, ASSIGN), _found("access", 1, ACCESS), _found("hex", 2, HEX), _found("random", 3, RANDOM)])}),
u AS (SELECT r, kind, place, unnest(range(1, len(hits) + 1)) AS k, hits, gaps FROM f),
p AS (SELECT r, kind, place, hits[k] AS hit, CASE kind WHEN 'assign' THEN regexp_extract(hits[k], {_quoted(ASSIGN_VALUE)}, 1) ELSE hits[k] END AS value,
  CAST(sum(length(gaps[k]) + length(hits[k])) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS stop FROM u),
v AS (SELECT r, kind, place, value, stop - length(hit) AS start, stop FROM p WHERE kind <> 'assign' OR length(value) >= 12),
c AS (SELECT * FROM v WHERE kind <> 'random' OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM v o WHERE o.r = v.r AND o.kind <> 'random' AND v.start < o.stop AND o.start < v.stop)),
w AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) < {WIDE_OWNERS} AS live FROM c JOIN d USING (r) GROUP BY value),
x AS (SELECT c.*, live, kind || ':' || start || ':' || stop AS shown FROM c JOIN w USING (value)),
g AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, sha256(coalesce(string_agg(shown, ',' ORDER BY start, place) FILTER (WHERE kind <> 'random'), '')) AS base_sha256,
  coalesce(string_agg(shown, ',' ORDER BY start, place) FILTER (WHERE kind <> 'random' OR live), '') AS spans, count_if(live) AS n_live, count_if(NOT live) AS n_example FROM x GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example FROM d LEFT JOIN g USING (r)
"""
