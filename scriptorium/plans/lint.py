"""Lint rules that are windows over the token stream.

All of them are conditions of one pass: the columns each needs are taken from
the neighbouring tokens by windows over (document, order), and the codes that
hold for a token are exploded from one array.
"""

from __future__ import annotations

from scriptorium.functions import markers as mk
from scriptorium.functions.dialect import Spark
from scriptorium.plans.tokens import NUMBERED, ctes, sid

BODY = (
    "p m po pr cls pmo pm pmc pmr pi pi1 pi2 pi3 mi nb pc ph ph1 ph2 ph3 b pb q q1 q2 q3 q4 qr qc qa qm qm1 qm2 qm3 qd lh li li1 li2 li3 li4 lf lim lim1 lim2 lim3"
).split()
NOTES = ("f", "fe", "ef", "x", "ex")
#: Books whose text need not stand in chapters.
OUTSIDE = ("FRT", "INT", "BAK", "OTH", "CNC", "GLO", "TDX", "NDX")
CATEGORY = {
    "document": ("missing-id-marker", "verse-before-first-chapter", "duplicate-id-marker", "id-marker-not-at-file-start"),
    "context": ("chapter-metadata-outside-chapter", "verse-metadata-outside-verse"),
    "numbering": (
        "duplicate-chapter-number", "chapter-expected-increase-by-one", "duplicate-verse-number", "verse-expected-increase-by-one",
        "number-range-not-preceded-by-marker-expecting-number", "verse-text-follows-verse-range", "inconsistent-chapter-label",
    ),
}
WARNINGS = ("empty-paragraph",)


def dim(columns: list[str], name: str = "dim") -> str:
    """The catalog's columns as inline rows; it is small and the same for all data."""
    at = [x.split()[0] for x in mk.SCHEMA.split(", ")]
    pick = [at.index(c) for c in ["key", *columns]]
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"
    return f"(VALUES {', '.join('(' + ', '.join(lit(r[k]) for k in pick) + ')' for r in mk.rows())}) AS {name}(key, {', '.join(columns)})"


def key(d: Spark, marker: str) -> str:
    """The catalog key of a marker name."""
    m = d.replace(marker, r"^\+", "")
    return f"CASE WHEN {d.like(m, '^(thr|thc|th|tcr|tcc|tc)[0-9-]+$')} THEN {d.extract(m, '^(thr|thc|th|tcr|tcc|tc)', 1)} WHEN {d.like(m, '^vid[0-9]+-[se]$')} THEN 'vid' ELSE {m} END"


def with_catalog(d: Spark, columns: list[str], source: str = "tokens") -> str:
    return f"SELECT t.*, {', '.join('dim.' + c for c in columns)} FROM {source} t LEFT JOIN {dim(columns)} ON dim.key = {key(d, 't.marker')}"


def issues(d: Spark, docs: str) -> str:
    """CTEs up to ``issues`` (doc_id, idx, code, sid, marker, span_start, span_end)."""
    w, wd = "PARTITION BY doc_id ORDER BY idx", "PARTITION BY doc_id ORDER BY idx DESC"
    past, next_ = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"({wd} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    tag = "concat(kind, ':', coalesce(marker, ''))"
    blank = f"(kind = 'Text' AND {d.like('text', r'^[ \t\r\n]*$')})"
    marker = "kind = 'Marker'"
    scope = "coalesce(scope_kind, 'Unknown')"
    boundary = f"CASE WHEN marker IN ({mk.sql_list(BODY)}) OR {scope} IN ('Header', 'Chapter', 'Periph', 'Sidebar', 'TableRow', 'Unknown') THEN 'end' ELSE 'no' END"
    label = d.replace(d.extract("next_text", "^[^0-9]*"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    codes = {
        "missing-separator-after-marker": f"{marker} AND nk = 'Text' AND {scope} <> 'Milestone' AND NOT ({scope} = 'Unknown' AND marker LIKE 'z%') AND NOT {d.like('text', r'[ \t]$')} AND NOT {d.like('nt', r'^[ \t]')}",
        "empty-paragraph": f"{marker} AND marker IN ({mk.sql_list(x for x in BODY if x != 'b')}) AND next_full = 'end'",
        "number-range-after-chapter-marker": f"{marker} AND marker = 'c' AND coalesce(next_sig, '') <> 'Number:'",
        "missing-chapter-number": f"{marker} AND marker = 'c' AND coalesce(next_sig, '') <> 'Number:'",
        "verse-range-expected-after-verse-marker": f"{marker} AND marker = 'v' AND coalesce(next_sig, '') <> 'Number:'",
        "missing-verse-number": f"{marker} AND marker = 'v' AND coalesce(next_sig, '') <> 'Number:'",
        "verse-content-not-empty": f"{blank} AND prev_sig = 'Marker:v'",
        "duplicate-id-marker": f"{marker} AND marker = 'id' AND ids > 1",
        "id-marker-not-at-file-start": f"{marker} AND marker = 'id' AND content > 0",
        "verse-before-first-chapter": f"{marker} AND marker = 'v' AND chapters = 0 AND coalesce(book_now, '') NOT IN ({mk.sql_list(OUTSIDE)}) AND periphs = 0",
        "chapter-metadata-outside-chapter": f"{marker} AND marker IN ('ca', 'cp') AND NOT coalesce(prev_sig = 'Number:' AND prev2_sig = 'Marker:c', false)",
        "verse-metadata-outside-verse": f"{marker} AND marker IN ('va', 'vp') AND NOT coalesce(prev_sig = 'Number:' AND prev2_sig = 'Marker:v', false)",
        "unknown-marker": f"{marker} AND {scope} = 'Unknown'",
        "unknown-close-marker": f"kind = 'EndMarker' AND {scope} = 'Unknown'",
        "duplicate-chapter-number": "is_chapter AND nth_chapter > 1",
        "chapter-expected-increase-by-one": "is_chapter AND num_start <> coalesce(last_chapter, 0) + 1",
        "duplicate-verse-number": "is_verse AND repeats",
        "verse-expected-increase-by-one": "is_verse AND NOT repeats AND num_start <> coalesce(last_verse, 0) + 1",
        "inconsistent-chapter-label": "label IS NOT NULL AND label <> main_label",
        "number-range-not-preceded-by-marker-expecting-number": f"kind = 'Number' AND coalesce(prev_sig, '') NOT IN ({', '.join(repr('Marker:' + x) for x in NUMBERED)})",
        "verse-text-follows-verse-range": f"is_verse AND coalesce(next_verse, '') NOT IN ('Text:', {', '.join(repr('Marker:' + x) for x in NOTES)})",
        "missing-id-marker": "idx = 0 AND all_ids = 0",
        "missing-milestone-self-close": "kind = 'Milestone' AND coalesce(next_attr, '') <> 'MilestoneEnd:'",
    }
    pairs = d.array(*(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in codes.items()))
    return f"""{ctes(d, docs)},
known AS ({with_catalog(d, ["scope_kind"])}),
near AS (SELECT *, lead(kind) OVER ({w}) AS nk, lead(text) OVER ({w}) AS nt,
    {d.last(f"CASE WHEN kind <> 'Newline' THEN {tag} END")} OVER {past} AS prev_sig,
    {d.last(f"CASE WHEN kind <> 'Newline' THEN {tag} END")} OVER {next_} AS next_sig,
    {d.last("CASE WHEN kind <> 'Newline' THEN text END")} OVER {next_} AS next_text,
    {d.last(f"CASE WHEN kind IN ('Newline', 'OptBreak') OR {blank} THEN NULL WHEN {marker} THEN {boundary} ELSE 'no' END")} OVER {next_} AS next_full,
    {d.last(f"CASE WHEN kind IN ('Newline', 'AttributeList') OR {blank} THEN NULL ELSE {tag} END")} OVER {next_} AS next_verse,
    {d.last(f"CASE WHEN kind <> 'AttributeList' THEN {tag} END")} OVER {next_} AS next_attr,
    sum(CASE WHEN {marker} AND marker = 'id' THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ids,
    coalesce(sum(CASE WHEN kind IN ('Newline', 'OptBreak') OR {blank} THEN 0 ELSE 1 END) OVER {past}, 0) AS content,
    coalesce(sum(CASE WHEN {marker} AND marker = 'c' THEN 1 ELSE 0 END) OVER {past}, 0) AS chapters,
    coalesce(sum(CASE WHEN {marker} AND marker = 'periph' THEN 1 ELSE 0 END) OVER {past}, 0) AS periphs,
    {d.last("book_code")} OVER {past} AS book_now
  FROM known),
flagged AS (SELECT *, {d.last("CASE WHEN kind <> 'Newline' THEN prev_sig END")} OVER {past} AS prev2_sig,
    kind = 'Number' AND coalesce(prev_sig = 'Marker:c', false) AS is_chapter, kind = 'Number' AND coalesce(prev_sig = 'Marker:v', false) AS is_verse,
    CASE WHEN num_kind = 'Single' THEN num_start ELSE coalesce(num_end, num_start) END AS num_last,
    CASE WHEN {marker} AND marker = 'cl' AND next_sig = 'Text:' THEN nullif({label}, '') END AS label
  FROM near),
chaptered AS (SELECT *, {d.last("CASE WHEN is_chapter THEN num_start END")} OVER {past} AS last_chapter,
    CASE WHEN is_chapter THEN row_number() OVER (PARTITION BY doc_id, is_chapter, num_start ORDER BY idx) END AS nth_chapter FROM flagged),
versed AS (SELECT *, CASE WHEN coalesce(last_chapter, 0) = 0 THEN coalesce(chapter, 0) ELSE last_chapter END AS in_chapter FROM chaptered),
ranges AS (SELECT doc_id, idx, in_chapter, num_start, num_last FROM versed WHERE is_verse AND num_start <= num_last),
repeated AS (SELECT DISTINCT b.doc_id, b.idx FROM ranges a JOIN ranges b ON a.doc_id = b.doc_id AND a.in_chapter = b.in_chapter AND a.idx < b.idx AND a.num_start <= b.num_last AND b.num_start <= a.num_last),
sequenced AS (SELECT v.*, {d.last("CASE WHEN is_verse THEN num_last END")} OVER (PARTITION BY v.doc_id, in_chapter ORDER BY v.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_verse, r.idx IS NOT NULL AS repeats
  FROM versed v LEFT JOIN repeated r ON r.doc_id = v.doc_id AND r.idx = v.idx),
counted AS (SELECT *, count(label) OVER (PARTITION BY doc_id, label) AS n_label FROM sequenced),
ready AS (SELECT *, substr(max(CASE WHEN label IS NOT NULL THEN concat(lpad(CAST(n_label AS STRING), 12, '0'), label) END) OVER (PARTITION BY doc_id), 13) AS main_label,
    max(ids) OVER (PARTITION BY doc_id) AS all_ids FROM counted),
found AS (SELECT * FROM ({d.unnest("ready", f"doc_id, idx, {sid(d)} AS sid, marker, span_start, span_end", pairs, "k", "code")}) z WHERE code IS NOT NULL),
issues AS (SELECT doc_id, CASE WHEN whole THEN NULL ELSE idx END AS idx, code, CASE WHEN whole THEN NULL ELSE sid END AS sid, CASE WHEN whole THEN 'id' ELSE marker END AS marker,
    CASE WHEN whole THEN NULL ELSE span_start END AS span_start, CASE WHEN whole THEN NULL ELSE span_end END AS span_end
  FROM (SELECT *, code = 'missing-id-marker' AS whole FROM found) y)"""


def lint(d: Spark, docs: str) -> str:
    return f"WITH {issues(d, docs)} SELECT * FROM issues"


def summary(d: Spark, docs: str) -> str:
    """Counts by code, category and severity in one pass, with grouping sets."""
    kinds = " ".join(f"WHEN '{c}' THEN '{k}'" for k, codes in CATEGORY.items() for c in codes)
    cols = f"code, CASE code {kinds} ELSE 'structure' END AS category, CASE WHEN code IN ({mk.sql_list(WARNINGS)}) THEN 'warning' ELSE 'error' END AS severity"
    return f"""WITH {issues(d, docs)} SELECT coalesce(code, '*') AS code, coalesce(category, '*') AS category, coalesce(severity, '*') AS severity, CAST(count(*) AS BIGINT) AS n
      FROM (SELECT {cols} FROM issues) z GROUP BY GROUPING SETS ((code), (category), (severity), ())"""


def suppressed(d: Spark, docs: str, suppressions: str) -> str:
    """Issues without those whose code and reference a query (code, sid) names."""
    return f"""WITH {issues(d, docs)}, suppress AS (SELECT DISTINCT code, sid FROM ({suppressions}) z)
      SELECT i.doc_id, i.idx, i.code, i.sid FROM issues i LEFT JOIN suppress s ON s.code = i.code AND s.sid = i.sid WHERE s.code IS NULL"""


def document_summary(d: Spark, docs: str) -> str:
    """Totals of each document that has an issue."""
    kinds = " ".join(f"WHEN '{c}' THEN '{k}'" for k, codes in CATEGORY.items() for c in codes)
    count = lambda cond: f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""WITH {issues(d, docs)} SELECT doc_id, {count("category = 'document'")} AS n_document, {count("category = 'structure'")} AS n_structure, {count("category = 'context'")} AS n_context,
      {count("category = 'numbering'")} AS n_numbering, {count(f"code IN ({mk.sql_list(WARNINGS)})")} AS n_warning, CAST(count(*) AS BIGINT) AS n_total
      FROM (SELECT doc_id, code, CASE code {kinds} ELSE 'structure' END AS category FROM issues) z GROUP BY doc_id"""
