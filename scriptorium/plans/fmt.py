"""Format rules and text functions that are windows or expressions."""

from __future__ import annotations

import re

from scriptorium.functions import markers as mk
from scriptorium.functions.dialect import Spark
from scriptorium.plans.lint import BODY, with_catalog
from scriptorium.functions.markers import sql_list
from scriptorium.plans.tokens import ENTRY, ctes

W = "PARTITION BY doc_id ORDER BY idx"


def collapse_whitespace(d: Spark, docs: str) -> str:
    """Runs of spaces and tabs of text tokens become one space."""
    return f"WITH {ctes(d, docs)} SELECT doc_id, idx, kind, CASE WHEN kind = 'Text' THEN {d.replace('text', '[ ' + chr(9) + ']+', ' ')} ELSE text END AS text FROM tokens"


def collapse_linebreaks(d: Spark, docs: str) -> str:
    """A line break right after another is dropped."""
    return f"WITH {ctes(d, docs)}, n AS (SELECT *, lag(kind) OVER ({W}) AS before FROM tokens) SELECT doc_id, idx, kind, text FROM n WHERE NOT (kind = 'Newline' AND coalesce(before, '') = 'Newline')"


def line_start_space(d: Spark, docs: str) -> str:
    """Markers at the start of a line lose the white space before them."""
    return f"""WITH {ctes(d, docs)}, n AS (SELECT *, lag(kind) OVER ({W}) AS before FROM tokens)
      SELECT doc_id, idx, kind, CASE WHEN kind = 'Marker' AND coalesce(before, 'Newline') = 'Newline' THEN {d.replace("text", "^[ " + chr(9) + "]+", "")} ELSE text END AS text FROM n"""


def bridge_verses(d: Spark, docs: str) -> str:
    """Verses whose markers follow each other with no text between, by one each, become one range at the first."""
    space = " " + chr(9) + chr(10) + chr(13)
    return f"""WITH {ctes(d, docs)},
spaced AS (SELECT *, idx - sum(CASE WHEN kind = 'Text' AND {d.like('text', '^[' + space + ']*$')} THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_idx FROM tokens),
v AS (SELECT doc_id, idx, full_idx, num_start FROM spaced WHERE kind = 'Number' AND pk = 'Marker' AND pm = 'v'),
s AS (SELECT *, sum(CASE WHEN num_start = before + 1 AND full_idx = last_idx + 2 THEN 0 ELSE 1 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT *, lag(num_start) OVER ({W}) AS before, lag(full_idx) OVER ({W}) AS last_idx FROM v) z),
r AS (SELECT doc_id, min(idx) AS head, max(idx) AS tail, min(num_start) AS low, max(num_start) AS high FROM s GROUP BY doc_id, run HAVING count(*) > 1)
SELECT t.doc_id, t.idx, t.kind, CASE WHEN t.idx = r.head THEN concat({d.extract('t.text', '^[' + space + ']*')}, CAST(r.low AS STRING), '-', CAST(r.high AS STRING), {d.extract('t.text', '[' + space + ']*$')}) ELSE t.text END AS text
FROM tokens t LEFT JOIN r ON r.doc_id = t.doc_id AND t.idx BETWEEN r.head AND r.tail WHERE r.head IS NULL OR t.idx = r.head"""


OWN_LINE = "p m pi pi1 pi2 pi3 pi4 ms ms1 ms2 ms3 li li1 li2 li3 li4 b".split()
NEW_LINE = "cl cd d sp r mr sr s s1 s2 s3 s4".split()
POETRY = "q q1 q2 q3 q4 q5 qc qa qm qm1 qm2 qm3 qd".split()


def structural_linebreaks(d: Spark, docs: str) -> str:
    """(doc_id, formatted): line breaks before markers that start a line, after those that stand alone and after chapter numbers."""
    alone = f"(marker IN ({sql_list(OWN_LINE)}) OR scope_kind IS NULL OR {d.replace('marker', '^[+]', '')} LIKE 'z%')"
    starts = f"({alone} OR marker IN ({sql_list(NEW_LINE + POETRY)}))"
    return f"""WITH {ctes(d, docs)}, known AS ({with_catalog(d, ["scope_kind"])}),
n AS (SELECT *, lead(kind) OVER ({W}) AS after FROM known),
w AS (SELECT *, coalesce(after, '') <> 'Newline' AND (CASE WHEN kind = 'Marker' THEN CASE WHEN marker IN ({sql_list(POETRY)}) THEN coalesce(after, '') = 'Marker' ELSE {alone} END
    ELSE kind = 'Number' AND pk = 'Marker' AND pm = 'c' END) AS breaks FROM n),
p AS (SELECT *, lag(kind) OVER ({W}) AS before, lag(breaks) OVER ({W}) AS broken FROM w)
SELECT doc_id, {d.joined('idx', f"concat(CASE WHEN kind = 'Marker' AND {starts} AND before IS NOT NULL AND before <> 'Newline' AND NOT broken THEN {d.newline} ELSE '' END, text, CASE WHEN breaks THEN {d.newline} ELSE '' END)")} AS formatted FROM p GROUP BY doc_id"""


def whole(d: Spark, docs: str, rule) -> str:
    """(doc_id, formatted): the texts of a rule's rows joined."""
    return f"SELECT doc_id, {d.joined('idx', 'text')} AS formatted FROM ({rule(d, docs)}) z GROUP BY doc_id"


def duplicate_numbers(d: Spark, docs: str) -> str:
    """Text after a verse number loses the same number at its start."""
    lead = d.extract("text", "^[ " + chr(9) + "]*")
    return f"""WITH {ctes(d, docs)}, n AS (SELECT *, lag(kind) OVER ({W}) AS bk, lag(text) OVER ({W}) AS bt, lag(pk) OVER ({W}) AS bpk, lag(pm) OVER ({W}) AS bpm FROM tokens),
      m AS (SELECT *, {lead} AS space, {d.replace('bt', '^[ ' + chr(9) + chr(10) + chr(13) + ']+|[ ' + chr(9) + chr(10) + chr(13) + ']+$', '')} AS number FROM n)
      SELECT doc_id, idx, kind, CASE WHEN kind = 'Text' AND bk = 'Number' AND bpk = 'Marker' AND bpm = 'v' AND starts_with(substr(text, length(space) + 1), number) THEN concat(space, substr(text, length(space) + length(number) + 1)) ELSE text END AS text FROM m"""


def paragraph_space(d: Spark, docs: str) -> str:
    """Text after a marker that starts a line begins with one space at most."""
    alone = f"(bm IN ({sql_list(OWN_LINE + NEW_LINE + POETRY)}) OR bs IS NULL OR {d.replace('bm', '^[+]', '')} LIKE 'z%')"
    return f"""WITH {ctes(d, docs)}, known AS ({with_catalog(d, ["scope_kind"])}), n AS (SELECT *, lag(kind) OVER ({W}) AS bk, lag(marker) OVER ({W}) AS bm, lag(scope_kind) OVER ({W}) AS bs FROM known)
      SELECT doc_id, idx, kind, CASE WHEN kind = 'Text' AND bk = 'Marker' AND {alone} THEN {d.replace('text', '^ +', ' ')} ELSE text END AS text FROM n"""


def inline_separators(d: Spark, docs: str) -> str:
    """A space between markers, numbers and texts that touch, but for characters, notes and milestones."""
    like = "('Marker', 'EndMarker', 'Number', 'Text')"
    inline = "('Character', 'Note', 'Milestone')"
    return f"""WITH {ctes(d, docs)}, known AS ({with_catalog(d, ["scope_kind"])}), n AS (SELECT *, lag(kind) OVER ({W}) AS bk, lag(text) OVER ({W}) AS bt, lag(scope_kind) OVER ({W}) AS bs FROM known)
      SELECT doc_id, idx, kind, CASE WHEN kind IN {like} AND bk IN {like} AND coalesce(scope_kind, '') NOT IN {inline} AND coalesce(bs, '') NOT IN {inline}
        AND NOT {d.like('bt', '[ ' + chr(9) + chr(10) + chr(13) + ']$')} AND NOT {d.like('text', '^[ ' + chr(9) + chr(10) + chr(13) + ']')} THEN concat(' ', text) ELSE text END AS text FROM n"""


def default_paragraph(d: Spark, docs: str) -> str:
    """A paragraph before the first verse of each chapter that has none, if the first chapter with a verse has none."""
    seg = f"sum(CASE WHEN kind = 'Marker' AND marker = 'c' THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {ctes(d, docs)}, known AS ({with_catalog(d, ["scope_kind", "spec_kind"])}),
n AS (SELECT *, kind = 'Marker' AND scope_kind IN ('Block', 'TableRow') AND spec_kind <> 'Figure' AS is_block, {seg} AS seg FROM known),
firsts AS (SELECT *, min(CASE WHEN kind = 'Number' THEN idx END) OVER (PARTITION BY doc_id, seg) AS num FROM n),
versed AS (SELECT *, min(CASE WHEN kind = 'Marker' AND marker = 'v' AND idx > num THEN idx END) OVER (PARTITION BY doc_id, seg) AS v_idx FROM firsts),
lacks AS (SELECT doc_id, seg, v_idx, max(CASE WHEN is_block AND idx > num AND idx < v_idx THEN 1 ELSE 0 END) AS has FROM versed WHERE seg > 0 AND v_idx IS NOT NULL GROUP BY doc_id, seg, v_idx),
chosen AS (SELECT doc_id, v_idx FROM (SELECT *, first_value(has) OVER (PARTITION BY doc_id ORDER BY seg) AS decides FROM lacks) z WHERE has = 0 AND decides = 0)
SELECT t.doc_id, t.idx, t.kind, CASE WHEN c.v_idx IS NULL THEN t.text ELSE concat({d.text(chr(92) + 'p')}, t.text) END AS text FROM tokens t LEFT JOIN chosen c ON c.doc_id = t.doc_id AND c.v_idx = t.idx"""


def remove_empty_paragraphs(d: Spark, docs: str) -> str:
    """Tokens left when body paragraphs without content, and what is blank after them, are dropped."""
    back = "(PARTITION BY doc_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    now = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    blank = f"(kind IN ('Newline', 'OptBreak') OR (kind = 'Text' AND {d.like('text', r'^[ \t\r\n]*$')}))"
    end = f"CASE WHEN marker IN ({sql_list(BODY)}) OR coalesce(scope_kind, 'Unknown') IN ('Header', 'Chapter', 'Periph', 'Sidebar', 'TableRow', 'Unknown') THEN 'end' ELSE 'no' END"
    return f"""WITH {ctes(d, docs)}, known AS ({with_catalog(d, ["scope_kind"])}),
n AS (SELECT *, {d.last(f"CASE WHEN {blank} THEN NULL WHEN kind = 'Marker' THEN {end} ELSE 'no' END")} OVER {back} AS upto FROM known),
e AS (SELECT *, CASE WHEN {blank} THEN NULL WHEN kind = 'Marker' AND marker IN ({sql_list(x for x in BODY if x != 'b')}) AND upto = 'end' THEN 'empty' ELSE 'some' END AS block FROM n),
c AS (SELECT *, {d.last("block")} OVER {now} AS inside FROM e)
SELECT doc_id, idx, kind, text FROM c WHERE coalesce(inside, 'some') <> 'empty'"""


def recover_markers(d: Spark, tokens: str) -> str:
    """(doc_id, idx, piece, kind, text): texts of a query (doc_id, idx, kind, text) cut where a known marker stands in them before a space or tab."""
    names = "|".join(sorted((k for k in _known()), key=lambda x: (-len(x), x)))
    rx = r"^([^\\]*)\\(" + names + r"|(?:thr|thc|th|tcr|tcc|tc)[0-9-]+)[ \t]([\s\S]*)$"
    part = lambda k: d.extract("text", rx, k)
    return f"""WITH given AS ({tokens}), cut AS (SELECT *, kind = 'Text' AND {d.like('text', rx)} AS hit FROM given),
      parts AS (SELECT doc_id, idx, 0 AS piece, 'Text' AS kind, {part(1)} AS text FROM cut WHERE hit UNION ALL SELECT doc_id, idx, 1, 'Marker', concat({d.text(chr(92))}, {part(2)}) FROM cut WHERE hit
      UNION ALL SELECT doc_id, idx, 2, 'Text', {part(3)} FROM cut WHERE hit) SELECT doc_id, idx, piece, kind, text FROM parts WHERE text <> ''"""


def _known() -> list[str]:
    return [m for m in dict.fromkeys(r[0] for r in mk.rows()) if mk.public_kind(m) != "Unknown" and re.fullmatch("[a-z0-9-]+", m)]


def attributes(d: Spark, docs: str) -> str:
    """(doc_id, idx, n, entry_key, entry_value): entries of attribute lists, values with their escapes undone."""
    return f"""WITH {ctes(d, docs)}, a AS (SELECT doc_id, idx, text FROM tokens WHERE kind = 'AttributeList')
SELECT doc_id, idx, CAST(n AS INT) AS n, {d.extract("entry", ENTRY, 1)} AS entry_key, {d.replace(d.extract("entry", ENTRY, 2), r"\\(.)", "$1" if d.name == "spark" else r"\1")} AS entry_value
FROM ({d.unnest("a", "doc_id, idx", d.extract_all("text", ENTRY), "n", "entry")}) z"""


def html_escape(d: Spark, pages: str) -> str:
    x = "html"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"SELECT page_id, replace({x}, chr(39), '&#39;') AS escaped FROM {pages}"


def note_labels(d: Spark, docs: str) -> str:
    """Notes numbered within each document, with labels, caller and place."""
    letter = lambda k: f"CASE WHEN {k} > 0 THEN chr(CAST(97 + ({k} - 1) % 26 AS INT)) ELSE '' END"
    up = lambda k: d.div(f"({k} - 1)", "26")
    second = f"CASE WHEN number > 26 THEN {up('number')} ELSE 0 END"
    third = f"CASE WHEN number > 702 THEN {up('(' + up('number') + ')')} ELSE 0 END"
    digits = [("m", "", ""), ("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x")]

    def roman(place: int, one: str, five: str, ten: str) -> str:
        k = f"({d.div('number', str(10 ** (3 - place)))} % 10)"
        words = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten] if five else [one * n for n in range(10)]
        return "CASE " + k + "".join(f" WHEN {n} THEN '{x}'" for n, x in enumerate(words)) + " ELSE '' END"

    return f"""WITH {ctes(d, docs)}, n AS (SELECT *, lead(text) OVER ({W}) AS after FROM tokens),
own AS (SELECT doc_id, idx, marker, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS number, {d.replace("after", "^[ " + chr(9) + "]+|[ " + chr(9) + "]+$", "")} AS caller, book, chapter, verse
FROM n WHERE kind = 'Marker' AND marker IN ('f', 'fe', 'ef', 'x', 'ex'))
SELECT *, concat({letter(f"({third})")}, {letter(f"({second})")}, {letter('number')}) AS alpha, concat({', '.join(roman(k, *x) for k, x in enumerate(digits))}) AS roman FROM own"""
