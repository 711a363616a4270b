"""DuckDB SQL for the queries that SQL can express on the small tables, by brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP_K = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rowid AS r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM (SELECT *, row_number() OVER () AS rowid FROM fine WHERE vec_id % 50 = 0) q JOIN fine c ON q.n = c.n AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


def _components(edges: str) -> str:
    """CTEs: comp (id, component) for every id that has a link in the CTE edges (a, b), which is symmetric."""
    return f"""reach AS (SELECT DISTINCT a, b FROM {edges} UNION SELECT r.a, e.b FROM reach r JOIN {edges} e ON r.b = e.a),
comp AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""


#: All pairs of documents that share a shingle of four words; ids are taken to be unique.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
{_components("e")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id"""

#: All pairs of vectors; ids are taken to be unique.
NEAR_VECTORS = f"""
WITH RECURSIVE fine AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.n = b.n AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{_components("e")},
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(component, vec_id)::BIGINT AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN comp ON comp.id = vec_id"""

_CONTROL = r"\\|</?s>|\[/?INST\]|<</?SYS>>|<\|"
#: Digests straight from the rows; the length of the formatted text from what the template adds and what is escaped.
CHAT = rf"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) t(turn, role, text)),
x AS (
  SELECT *, coalesce(role, '') AS ro, coalesce(text, '') AS te FROM r),
y AS (
  SELECT *, length(ro) + length(te) + 11 + len(regexp_extract_all(te, '{_CONTROL}')) + len(regexp_extract_all(ro, '\\|\]'))
    + len(list_filter(range(2, length(ro) + 1), lambda i: substr(ro, i, 1) NOT IN ('\', ']') AND substr(ro, i - 1, 1) IN ('<', '['))) AS size FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(ro || chr(10) || te || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(te)) FILTER (ro = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(te, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (ro = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM y GROUP BY conv_id"""
