"""Verse text by reference.

Text counts while a reference is open, no note is open and the last paragraph
may hold verses. A chapter or verse number ends what was open; a repeated
reference takes its last text. A note is open while its marker was opened more
often than closed since the count was last zero, per note marker.
"""

from __future__ import annotations

from scriptorium.functions.dialect import Spark
from scriptorium.plans.lint import with_catalog
from scriptorium.plans.tokens import ctes

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOTES = ("f", "fe", "ef", "x", "ex")


def verses(d: Spark, docs: str) -> str:
    """CTEs up to ``verses`` (doc_id, ref, text)."""
    w = "PARTITION BY doc_id ORDER BY idx"
    now = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    net = {n: f"sum(CASE WHEN marker = '{n}' THEN CASE kind WHEN 'Marker' THEN 1 WHEN 'EndMarker' THEN -1 ELSE 0 END ELSE 0 END) OVER {now}" for n in NOTES}
    low = {n: f"min(d_{n}) OVER {now}" for n in NOTES}
    is_open = " OR ".join(f"d_{n} > CASE WHEN l_{n} < 0 THEN l_{n} ELSE 0 END" for n in NOTES)
    return f"""{ctes(d, docs)},
known AS ({with_catalog(d, ["scope_kind", "supports_verse"])}),
state AS (SELECT *, kind = 'Number' AND pk = 'Marker' AND pm IN ('c', 'v') AS ends, coalesce({d.last("CASE WHEN kind = 'Marker' AND scope_kind = 'Block' THEN supports_verse END")} OVER {now}, true) AS holds,
    {', '.join(f"{x} AS d_{n}" for n, x in net.items())} FROM known),
opened AS (SELECT *, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER {now} AS segment, {', '.join(f"{x} AS l_{n}" for n, x in low.items())} FROM state),
segments AS (SELECT *, first_value(CASE WHEN ends AND pm = 'v' AND book IS NOT NULL AND chapter > 0 THEN concat(book, ' ', CAST(chapter AS STRING), ':', CAST(num_start AS STRING)) END)
    OVER (PARTITION BY doc_id, segment ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ref FROM opened),
taken AS (SELECT doc_id, idx, segment, ref, text, lag(text) OVER (PARTITION BY doc_id, segment ORDER BY idx) AS before
  FROM segments WHERE kind = 'Text' AND segment > 0 AND ref IS NOT NULL AND holds AND NOT ({is_open})),
seamed AS (SELECT doc_id, idx, segment, ref, CASE WHEN {d.like("before", SPACE + "$")} THEN {d.replace("text", "^" + SPACE + "+", "")} ELSE text END AS text FROM taken),
passages AS (SELECT doc_id, segment, ref, {d.replace(d.joined("idx", "text"), f"^{SPACE}+|{SPACE}+$", "")} AS text FROM seamed GROUP BY doc_id, segment, ref),
verses AS (SELECT doc_id, ref, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ref ORDER BY segment DESC) AS r FROM passages WHERE text <> '') z WHERE r = 1)"""
