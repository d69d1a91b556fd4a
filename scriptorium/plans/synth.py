"""Marked-up documents made from the plain tables, alike in Spark and DuckDB."""

from __future__ import annotations

from scriptorium.functions.dialect import Spark

#: Ends of documents, by doc_id modulo ENDINGS_EACH; together they break every rule that a source can break.
ENDINGS_EACH = 29
ENDINGS = {
    1: "\\p\n\\p\n\\v 90 empty before\n",
    2: "\\c\n\\p\n\\v 91 no number\n",
    3: "\\p text \\ca 2\\ca* and \\va 3\\va* end\n",
    4: "\\id EXO again\n",
    5: "\\c 1\n\\p\n\\v 1 chapter again\n",
    6: "\\c 60\n\\cl Section 60\n\\p\n\\v 1 other label\n\\c 61\n\\cl Part 61\n\\p\n\\v 1 label\n",
    7: "\\p\n\\v 92 \n\\p\n",
    8: '\\p\n\\v 93 \\qt-s |sid="2" open quote\n',
    9: "\\p\n\\v 94 stray \\ft note text and \\nd* closed\n",
    10: "\\p\n\\v 95 \\f + \\ft never closed\n\\p more \\w a \\nd b\\w* c\n",
    11: "\n\n\\p\n\n\\v 96 blank lines\n\n",
    12: "\\tr \\th1 head\\thr2 right\n\\tr \\tc1 cell\\tcr2 one\n",
    13: "\\esb \\cat note\\cat*\n\\p inside\n\\esbe\n",
    14: "\\p\n\\v 97 \\v 98 \\v 99 bridged text\n",
    15: "\\p\n\\v 97\n\\v 98 orphan\n",
    16: "\\p\n\\v 10-12 10. ten 11) eleven\n",
    17: "\\p\n\\v 13 13 thirteen\n",
    18: "\\cl Before\n\\c 70\n\\v 1 no paragraph\n",
    19: "\\q1\n\\v 14 poem\n\\q2 \n\\s1 Head\n\\r (Ref 1:1)\n",
    20: "\\v 1-20000 wide\n\\v 15000 again\n",
    21: "\\v 4,6 sequence \\v 7-8,10 both \\v 11a-12b suffix\n",
    22: '\\p \\fig alt|src="a.jpg" size="col" ref="1.1"\\fig* \\xt 1.1|GEN 1:1\\xt* \\rb word|gloss\\rb*\n',
    23: "\\p \\x - \\xo 1.1 \\xt Mat 1.1\\x* and \\ef - \\ft ext\\ef*\n",
    24: '\\periph Title|id="title"\n\\p in a peripheral\n',
    25: "\\p\r\n\\v 15 carriage\r\n\\v 16 // break \\zcustom mark\\zcustom* \\+nd x\\+nd*\n",
}
#: Lines that an editor drops, and one that is added.
DROPPED = ("\\v 90 empty before\n", "\\v 94 stray \\ft note text and \\nd* closed\n", "\\v 98 orphan\n", "\\v 1 chapter again\n")
ADDED = "\\p\n\\v 201 added line\n"


def usfm_docs(d: Spark, documents: str) -> str:
    """(doc_id, source): each text line a verse; some with ranges, repeats, gaps, notes, attributes and faults."""
    nl, b = d.newline, d.text("\\")

    def m(s: str) -> str:  # marker text
        return d.text(s)

    chapter = f"CASE WHEN ({{n}}) % 9 = 1 THEN concat({m(chr(92) + 'c ')}, CAST({d.div('({n})', '9')} + CASE WHEN doc_id % 13 = 1 AND ({{n}}) > 9 THEN 2 ELSE 1 END AS STRING), {nl}, CASE WHEN doc_id % 5 = 0 THEN concat({m(chr(92) + 'cl Part ')}, CAST(({{n}}) AS STRING), {nl}) ELSE '' END, CASE WHEN doc_id % 6 = 3 THEN '' ELSE concat({m(chr(92) + 'p')}, {nl}) END) ELSE '' END"
    number = f"CASE WHEN doc_id % 11 = 2 AND ({{n}}) % 9 = 5 THEN '' WHEN doc_id % 7 = 3 AND ({{n}}) % 9 = 4 THEN ' 3' WHEN ({{n}}) % 10 = 7 THEN concat(' ', CAST((({{n}}) - 1) % 9 + 1 AS STRING), '-', CAST((({{n}}) - 1) % 9 + 2 AS STRING)) ELSE concat(' ', CAST((({{n}}) - 1) % 9 + 1 AS STRING), CASE WHEN doc_id % 9 = 4 THEN 'a' ELSE '' END) END"
    extra = f"""CASE WHEN ({{n}}) % 4 = 1 THEN {m(chr(92) + 'f + ' + chr(92) + 'fr 1:1 ' + chr(92) + 'ft note text' + chr(92) + 'f*')} WHEN ({{n}}) % 6 = 2 THEN {m(' ' + chr(92) + 'w grace|lemma="x y" strong="G1"' + chr(92) + 'w* more')}
      WHEN ({{n}}) % 12 = 6 THEN {m(' ' + chr(92) + 'qt-s |sid="1" who="Paul"' + chr(92) + '*said')} WHEN ({{n}}) % 15 = 11 THEN {m(' ' + chr(92) + 'xyz odd' + chr(92) + 'xyz* end')} WHEN ({{n}}) % 8 = 3 THEN concat({nl}, {m(chr(92) + 'q2')}, CASE WHEN doc_id % 4 = 1 THEN '' ELSE ' ' END, 'Poetry') ELSE '' END"""
    line = f"concat({chapter}, {b}, 'v', {number}, ' ', l, {extra})"
    book = "CASE doc_id % 5 WHEN 0 THEN 'GEN' WHEN 1 THEN 'EXO' WHEN 2 THEN 'MAT' WHEN 3 THEN 'JHN' ELSE 'XYZ' END"
    head = f"CASE WHEN doc_id % 19 = 7 THEN '' ELSE concat({b}, 'id ', {book}, ' sample', {nl}, {b}, 'h Book', {nl}, {b}, 'mt1 Title', {nl}) END"
    early = f"CASE WHEN doc_id % 31 = 3 THEN {m(chr(92) + 'p' + chr(10) + chr(92) + 'v 1 too early' + chr(10))} ELSE '' END"
    ending = "CASE doc_id % " + str(ENDINGS_EACH) + "".join(f" WHEN {k} THEN {m(x)}" for k, x in ENDINGS.items()) + " ELSE '' END"
    return f"SELECT doc_id, concat({head}, {early}, {d.lines('text', line)}, {nl}, {ending}) AS source FROM {documents} WHERE text IS NOT NULL"


def edited_docs(d: Spark, documents: str) -> str:
    """The same documents after an editor: texts shouted, lines dropped or added and spaces doubled by rule."""
    return f"SELECT doc_id, current AS source FROM ({pairs(d, documents)}) z"


def pairs(d: Spark, documents: str) -> str:
    """(doc_id, baseline, current): both versions of each document in a row."""
    shorter = "source"
    for line in DROPPED:
        shorter = f"replace({shorter}, {d.text(line)}, '')"
    return f"""SELECT doc_id, source AS baseline, concat(CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN replace(source, ' the ', '  the ') WHEN 2 THEN replace({shorter}, 'note text', 'NOTE TEXT')
      ELSE replace({shorter}, concat({d.text(chr(92) + 'q2')}, ' Poetry', {d.newline}), '') END, CASE WHEN doc_id % 5 = 2 THEN {d.text(ADDED)} ELSE '' END) AS current FROM ({usfm_docs(d, documents)}) y"""
