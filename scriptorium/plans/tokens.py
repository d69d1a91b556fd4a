"""From source text to tokens, as one chain of SQL steps.

A document is split into lexemes by one regular expression, lexemes are given
their payloads (book code, number), white space is attached to its neighbour,
and ids of book, chapter and verse are carried forward. Every window has the same
partitioning and order, so there is one exchange by document and one sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from scriptorium.functions.dialect import SPARK, Spark
from scriptorium.functions.markers import BOOKS, sql_list

#: One alternation for all lexemes; order takes the place of longest match.
LEXEME = (
    r"\\\*|\\\+[a-z]+[0-9]*\*|\\\+[a-z]+[0-9]*|\\[a-z]+[0-9]*-[se]|\\[a-z]+[0-9]*(?:-[0-9]+)?\*|\\[a-z]+[0-9]*(?:-[0-9]+)?"
    r"|\|(?:[ \t]+|[^= \t\r\n\\|]+=\"(?:[^\"\\]|\\[\s\S])*\")*|//|[ \t]+|\r?\n|\r|[^ \t\r\n\\|/][^\\\r\n|/]*|[\s\S]"
).replace('\\"', '"')
NUMBER = r"^[0-9]+[\p{L}\p{M}]*(?:\x{200F}?[-,][0-9]+[\p{L}\p{M}]*)*"
ENTRY = r'([^= \t\r\n\\|]+)="((?:[^"\\]|\\[\s\S])*)"'
NUMBERED = ("c", "cp", "ca", "v", "vp", "va")
MOST = 4294967295


def ctes(d: Spark, docs: str, prefix: str = "") -> str:
    """CTEs up to ``tokens``, from a query with (doc_id, source); prefix keeps two chains apart."""
    p = prefix
    w = "PARTITION BY doc_id ORDER BY o"
    up_to = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = "(PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    named = d.like("lex", r"^\\\+?[a-z]")
    glued = "('Newline', 'AttributeList')"
    return f"""
{p}docs AS ({docs}),
{p}lexemes AS (SELECT doc_id, i, lex,
    CASE WHEN {named} THEN CASE WHEN {d.like("lex", r"\*$")} THEN 'EndMarker' WHEN {d.like("lex", r"-[se]$")} THEN 'Milestone' ELSE 'Marker' END
      WHEN lex = {d.text(chr(92) + "*")} THEN 'MilestoneEnd' WHEN {d.like("lex", r"^\|")} THEN 'AttributeList' WHEN lex = '//' THEN 'OptBreak'
      WHEN {d.like("lex", r"^[ \t]+$")} THEN 'Whitespace' WHEN {d.like("lex", r"^[\r\n]+$")} THEN 'Newline' ELSE 'Text' END AS kind,
    CASE WHEN {named} THEN {d.extract("lex", r"\+?[a-z]+[0-9]*(?:-[0-9]+|-[se])?")} END AS marker
  FROM ({d.unnest(f"{p}docs", "doc_id", d.extract_all("source", LEXEME), "i", "lex")})),
{p}pending AS (SELECT *, {d.last("CASE WHEN kind IN ('Whitespace', 'Newline') THEN NULL WHEN kind = 'Marker' THEN marker ELSE '' END")} OVER {before} AS waits FROM {p}lexemes),
{p}payload AS (SELECT doc_id, i, lex, kind, marker,
    CASE WHEN kind <> 'Text' OR waits IS NULL THEN ''
      WHEN waits = 'id' AND {d.like("lex", r"^[A-Za-z0-9]{3}[\x00-\x7F]*$")} THEN substr(lex, 1, 3)
      WHEN waits IN ({sql_list(NUMBERED)}) AND coalesce({d.number(d.extract("lex", r"^[0-9]{1,18}"))}, 0) BETWEEN 1 AND {MOST} THEN {d.extract("lex", NUMBER)}
      ELSE '' END AS load, waits = 'id' AS is_book
  FROM {p}pending),
{p}pieces AS (SELECT doc_id, i * 2 + j AS o, piece, marker, CASE WHEN load = '' THEN kind WHEN j = 1 THEN 'Text' WHEN is_book THEN 'BookCode' ELSE 'Number' END AS kind
  FROM ({d.unnest(f"{p}payload", "doc_id, i, kind, marker, load, is_book", f"CASE WHEN load = '' OR load = lex THEN {d.array('lex')} ELSE {d.array('load', 'substr(lex, length(load) + 1)')} END", "j", "piece")})),
{p}around AS (SELECT *, lag(kind) OVER ({w}) AS pk, lag(piece) OVER ({w}) AS pt, lead(kind) OVER ({w}) AS nk, lead(piece) OVER ({w}) AS nt, lead(kind, 2) OVER ({w}) AS nnk FROM {p}pieces),
{p}attached AS (SELECT doc_id, o, marker, CASE WHEN kind = 'Whitespace' THEN 'Text' ELSE kind END AS kind, piece,
    concat(CASE WHEN pk = 'Whitespace' AND kind NOT IN {glued} THEN pt ELSE '' END, piece,
      CASE WHEN nk = 'Whitespace' AND (nnk IS NULL OR nnk IN {glued}) THEN nt ELSE '' END) AS text
  FROM {p}around WHERE kind <> 'Whitespace' OR (pk IS NULL AND (nk IS NULL OR nk IN {glued}))),
{p}islands AS (SELECT *, sum(CASE WHEN kind = 'Text' AND before = 'Text' THEN 0 ELSE 1 END) OVER {up_to} AS island
  FROM (SELECT *, lag(kind) OVER ({w}) AS before FROM {p}attached) z),
{p}merged AS (SELECT doc_id, island AS o, min(kind) AS kind, min(marker) AS marker, min(CASE WHEN kind <> 'Text' THEN piece END) AS piece, {d.joined("o", "text")} AS text
  FROM {p}islands GROUP BY doc_id, island),
{p}numbered AS (SELECT *, CAST(o - 1 AS INT) AS idx, CASE WHEN kind = 'Number' THEN {d.number(d.extract("piece", "^[0-9]+"))} END AS num_start,
    lag(kind) OVER ({w}) AS pk, lag(marker) OVER ({w}) AS pm, lead(kind) OVER ({w}) AS nk, lead(piece) OVER ({w}) AS np FROM {p}merged),
{p}events AS (SELECT *, CASE WHEN kind = 'BookCode' THEN piece END AS book_code,
    CASE WHEN kind = 'Marker' AND marker IN ('c', 'v') AND nk = 'Number' THEN {d.number(d.extract("np", "^[0-9]+"))} END AS opens
  FROM {p}numbered),
{p}carried AS (SELECT *, {d.last("book_code")} OVER {up_to} AS book, coalesce({d.last("CASE WHEN marker = 'c' THEN opens END")} OVER {up_to}, 0) AS running FROM {p}events),
{p}placed AS (SELECT *, {d.last("CASE WHEN kind = 'BookCode' THEN 0 WHEN opens IS NOT NULL THEN running END")} OVER {up_to} AS at_chapter,
    {d.last("CASE WHEN kind = 'BookCode' OR (opens IS NOT NULL AND marker = 'c') THEN 0 WHEN opens IS NOT NULL THEN opens END")} OVER {up_to} AS at_verse,
    {d.first("book_code")} OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_book,
    CAST(sum({d.bytes("text")}) OVER {up_to} AS BIGINT) AS span_end
  FROM {p}carried),
{p}tokens AS (SELECT doc_id, idx, concat(coalesce(book, first_book, 'unknown'), '-', CAST(idx AS STRING)) AS id, kind, text,
    span_end - {d.bytes("text")} AS span_start, span_end, book, CASE WHEN book IS NOT NULL THEN at_chapter END AS chapter, CASE WHEN book IS NOT NULL THEN at_verse END AS verse,
    marker, coalesce(marker LIKE '+%', false) AS nested, num_start,
    CASE WHEN kind = 'Number' THEN {d.number(d.extract("piece", r"^.*-([0-9]+)", 1))} END AS num_end,
    CASE WHEN kind = 'Number' THEN CASE WHEN piece LIKE '%-%' AND piece LIKE '%,%' THEN 'SequenceWithRange' WHEN piece LIKE '%-%' THEN 'Range' WHEN piece LIKE '%,%' THEN 'Sequence' ELSE 'Single' END END AS num_kind,
    book_code, CASE WHEN kind = 'BookCode' THEN book_code IN ({sql_list(sorted(BOOKS))}) END AS book_valid, pk, pm
  FROM {p}placed)"""


def sid(d: Spark, style: str = "lint") -> str:
    """A reference as text; lint writes GEN 1 before the first verse, diff GEN 1:0."""
    full = "book || ' ' || CAST(chapter AS STRING) || ':' || CAST(verse AS STRING)"
    return full if style == "diff" else f"CASE WHEN verse = 0 THEN book || ' ' || CAST(chapter AS STRING) ELSE {full} END"


def over(docs: DataFrame, build) -> DataFrame:
    """Run build(dialect, docs query), SQL text, over a table with (doc_id, source)."""
    view = f"scriptorium_{uuid.uuid4().hex}"
    docs.createOrReplaceTempView(view)
    out = docs.sparkSession.sql(build(SPARK, f"SELECT doc_id, source FROM {view}"))
    docs.sparkSession.catalog.dropTempView(view)  # the plan has it already
    return out


def tokens(docs: DataFrame) -> DataFrame:
    """The tokens of a table with (doc_id, source)."""
    return over(docs, lambda d, query: f"WITH {ctes(d, query)} SELECT * FROM tokens").drop("pk", "pm")
