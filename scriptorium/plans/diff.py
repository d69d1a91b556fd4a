"""Blocks of one reference, their differences between two versions, and reverts.

A block is a maximal run of tokens with one reference; its id has the reference
and its first token's id, so it is unique in a document. Blocks of both versions
meet in a full outer join on the id; deleted and added blocks of the same
reference are then paired in order.
"""

from __future__ import annotations

from scriptorium.functions.dialect import Spark
from scriptorium.plans.tokens import ctes, sid
from scriptorium.plans.vref import SPACE


def blocks(d: Spark, docs: str, prefix: str = "") -> str:
    """CTEs up to ``blocks`` (doc_id, block_id, semantic_sid, begin, end_exclusive, prev_block_id, text_full, book, chapter)."""
    p, w = prefix, "PARTITION BY doc_id ORDER BY idx"
    w2 = "PARTITION BY doc_id ORDER BY begin"
    return f"""{ctes(d, docs, p).replace("FROM placed", f"FROM {p}placed")},
{p}sids AS (SELECT doc_id, idx, id, text, book, chapter, coalesce({sid(d, "diff")}, '') AS sid FROM {p}tokens),
{p}runs AS (SELECT *, sum(CASE WHEN sid = before THEN 0 ELSE 1 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(sid) OVER ({w}) AS before FROM {p}sids) z),
{p}grouped AS (SELECT doc_id, run, min(sid) AS semantic_sid, min(book) AS book, min(chapter) AS chapter, CAST(min(idx) AS BIGINT) AS begin, CAST(max(idx) + 1 AS BIGINT) AS end_exclusive,
    min(CASE WHEN first_idx = idx THEN id END) AS first_id, {d.joined("idx", "text")} AS text_full
  FROM (SELECT *, min(idx) OVER (PARTITION BY doc_id, run) AS first_idx FROM {p}runs) z GROUP BY doc_id, run),
{p}named AS (SELECT *, concat(semantic_sid, '::', first_id) AS block_id FROM {p}grouped),
{p}blocks AS (SELECT doc_id, block_id, semantic_sid, begin, end_exclusive, lag(block_id) OVER ({w2}) AS prev_block_id, text_full, book, chapter FROM {p}named)"""


def _plain(d: Spark, x: str) -> str:
    """Text without markers, for display."""
    bare = d.replace(x, r"\\[A-Za-z][A-Za-z0-9]*\*?", "")
    return d.replace(d.replace(bare, "[ \t]+", " "), f"^{SPACE}+|{SPACE}+$", "")


def diffs(d: Spark, baseline: str, current: str) -> str:
    """CTEs up to ``diffs``: status and both texts of every block of either version."""
    tight = lambda x: d.replace(x, SPACE + "+", "")
    return f"""{blocks(d, baseline, "a_")},
{blocks(d, current, "b_")},
joined AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.block_id, b.block_id) AS block_id, coalesce(a.semantic_sid, b.semantic_sid) AS semantic_sid,
    coalesce(a.book, b.book) AS book, coalesce(a.chapter, b.chapter) AS chapter, a.text_full AS original_text, b.text_full AS current_text, coalesce(a.begin, b.begin) AS place
  FROM a_blocks a FULL OUTER JOIN b_blocks b ON a.doc_id = b.doc_id AND a.block_id = b.block_id),
sides AS (SELECT *, CASE WHEN original_text IS NULL THEN 'Added' WHEN current_text IS NULL THEN 'Deleted' ELSE 'Both' END AS side FROM joined),
lone AS (SELECT *, row_number() OVER (PARTITION BY doc_id, semantic_sid, side ORDER BY place) AS nth FROM sides WHERE side <> 'Both'),
coalesced AS (
  SELECT doc_id, block_id, semantic_sid, book, chapter, original_text, current_text FROM sides WHERE side = 'Both'
  UNION ALL SELECT doc_id, max(CASE WHEN side = 'Deleted' OR n = 1 THEN block_id END), semantic_sid, min(book), min(chapter), max(original_text), max(current_text)
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, semantic_sid, nth) AS n FROM lone) z GROUP BY doc_id, semantic_sid, nth),
plain AS (SELECT *, {_plain(d, "original_text")} AS original_text_only, {_plain(d, "current_text")} AS current_text_only FROM coalesced),
diffs AS (SELECT doc_id, block_id, semantic_sid, book, chapter, coalesce(original_text, '') AS original_text, coalesce(current_text, '') AS current_text,
    coalesce(original_text_only, '') AS original_text_only, coalesce(current_text_only, '') AS current_text_only,
    CASE WHEN original_text IS NULL THEN 'Added' WHEN current_text IS NULL THEN 'Deleted' WHEN original_text = current_text THEN 'Unchanged' ELSE 'Modified' END AS status,
    CASE WHEN current_text IS NULL THEN 'Original' ELSE 'Current' END AS undo_side,
    coalesce(original_text <> current_text AND {tight("original_text")} = {tight("current_text")}, false) AS is_whitespace_change,
    CASE WHEN original_text IS NULL THEN current_text_only = '' WHEN current_text IS NULL THEN original_text_only = ''
      ELSE {tight("original_text")} <> {tight("current_text")} AND {tight("original_text_only")} = {tight("current_text_only")} END AS is_usfm_structure_change
  FROM plain)"""


def reverted(d: Spark, baseline: str, current: str, sids: str) -> str:
    """(doc_id, source): current text in which the blocks of these references, that have one block each, are those of the baseline again.

    Blocks that only the baseline has stay away: where they go depends on the
    blocks that are there when they are put back, which SQL can't follow.
    """
    return f"""WITH {blocks(d, baseline, "a_")},
{blocks(d, current, "b_")},
a_own AS (SELECT doc_id, semantic_sid, count(*) AS times, min(text_full) AS text_full FROM a_blocks GROUP BY doc_id, semantic_sid),
b_own AS (SELECT *, count(*) OVER (PARTITION BY doc_id, semantic_sid) AS times FROM b_blocks),
parts AS (SELECT b.doc_id, b.begin AS k, CASE WHEN {sids.replace("sid", "b.semantic_sid")} AND b.times = 1 AND coalesce(a.times, 1) = 1 THEN coalesce(a.text_full, '') ELSE b.text_full END AS part
  FROM b_own b LEFT JOIN a_own a ON a.doc_id = b.doc_id AND a.semantic_sid = b.semantic_sid)
SELECT doc_id, {d.joined("k", "part")} AS source FROM parts GROUP BY doc_id"""
