"""Edits of tokens: replace, delete and insert after, by the token's id.

An edit whose token isn't there does nothing; of several edits of one token the
first kind in the order delete, replace, insert counts.
"""

from __future__ import annotations

from scriptorium.functions.dialect import Spark
from scriptorium.plans.lint import with_catalog
from scriptorium.plans.tokens import ctes


def edited(d: Spark, tokens: str = "tokens", edits: str = "edits") -> str:
    """CTEs ``chosen`` and ``edited_tokens`` from tokens and edits (doc_id, id, action, new_text)."""
    rank = "CASE action WHEN 'delete' THEN 0 WHEN 'replace' THEN 1 ELSE 2 END"
    return f"""chosen AS (SELECT doc_id, id, action, new_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY {rank}, new_text) AS r FROM {edits}) z WHERE r = 1),
joined AS (SELECT t.doc_id, t.idx, t.kind, t.text, e.action, e.new_text FROM {tokens} t LEFT JOIN chosen e ON e.doc_id = t.doc_id AND e.id = t.id),
spliced AS ({d.unnest("joined", "doc_id, idx, kind, text, action", f"CASE WHEN action = 'replace' THEN {d.array('new_text')} WHEN action = 'insert' THEN {d.array('text', 'new_text')} ELSE {d.array('text')} END", "part", "piece")}),
edited_tokens AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, part) - 1 AS INT) AS idx, kind, piece AS text FROM spliced WHERE coalesce(action, '') <> 'delete')"""


def fixed(d: Spark, docs: str) -> str:
    """Documents' tokens after the fixes of missing separators, and with repeated line breaks deleted and a break after chapter numbers."""
    w = "PARTITION BY doc_id ORDER BY idx"
    return f"""WITH {ctes(d, docs)},
known AS ({with_catalog(d, ["scope_kind"])}),
near AS (SELECT *, lag(kind) OVER ({w}) AS bk, lag(marker) OVER ({w}) AS bm, lag(text) OVER ({w}) AS bt, lag(scope_kind) OVER ({w}) AS bs, lead(kind) OVER ({w}) AS ak FROM known),
edits AS (SELECT doc_id, id, CASE WHEN kind = 'Newline' THEN 'delete' WHEN kind = 'Number' THEN 'insert' ELSE 'replace' END AS action, CASE WHEN kind = 'Number' THEN {d.newline} WHEN kind = 'Text' THEN concat(' ', text) END AS new_text
  FROM near WHERE (kind = 'Newline' AND bk = 'Newline') OR (kind = 'Number' AND bk = 'Marker' AND bm = 'c' AND coalesce(ak, '') <> 'Newline')
    OR (kind = 'Text' AND bk = 'Marker' AND coalesce(bs, 'Unknown') NOT IN ('Milestone') AND NOT (bs IS NULL AND bm LIKE 'z%') AND NOT {d.like("bt", "[ " + chr(9) + "]$")} AND NOT {d.like("text", "^[ " + chr(9) + "]")})),
{edited(d)} SELECT doc_id, idx, kind, text FROM edited_tokens"""


def given(d: Spark, docs: str) -> str:
    """Documents' tokens after a table of edits: of every 50 tokens one deleted, one replaced and one followed by another, or deleted too."""
    mark = f"concat('<', CAST(idx AS STRING), '>')"
    return f"""WITH {ctes(d, docs)},
edits AS (SELECT doc_id, id, CASE idx % 50 WHEN 3 THEN 'delete' WHEN 4 THEN 'replace' ELSE 'insert' END AS action, CASE WHEN idx % 50 <> 3 THEN {mark} END AS new_text FROM tokens WHERE idx % 50 IN (3, 4, 5)
  UNION ALL SELECT doc_id, id, 'delete', {mark} FROM tokens WHERE idx % 50 = 5 AND doc_id % 2 = 0),
{edited(d)} SELECT doc_id, idx, kind, text FROM edited_tokens"""
