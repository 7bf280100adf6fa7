"""SQL of near-duplicate components for DuckDB: shingle sets, all pairs that share a shingle, and reachability."""

from __future__ import annotations

_COMPONENTS = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node AND r.root < e.b
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id{kept} FROM sets s JOIN least l ON l.node = s.doc_id
"""


def components_sql(words: int, kept: bool = False) -> str:
    """One row per document (ids are whole and distinct): its set's size and the least document that links at 85 % reach."""
    return _COMPONENTS.replace("{kept}", ", s.doc_id = l.component_id AS kept" if kept else "").replace("{k}", str(words))
