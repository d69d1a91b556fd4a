"""Operators over a table of documents (doc_id, source) whose rows are tokens, issues, verses, blocks and the like.

Each is one pass over Arrow batches without a shuffle or sort: a document is a
row, and its tokens never meet another document's. Rows come out in document
order; rows with one id or none are documents of their own, and a null source
is an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scriptorium.functions import markers as mk
from scriptorium.functions.labels import ordinal
from scriptorium.functions.spread import spread
from scriptorium.operators import blocks as blocks_
from scriptorium.operators import issues, rules
from scriptorium.operators import verses as verses_
from scriptorium.operators.columns import ATTRIBUTES, KINDS, MARKER, NEWLINE, NUMBER, SCHEMA, TEXT, Tokens, named, passes, pick, token_columns, utf8
from scriptorium.plans.tokens import ENTRY

Made = tuple[np.ndarray, list[pa.Array]]


def over(docs: DataFrame, schema: str, make: Callable[[Tokens], Made], column: str = "source") -> DataFrame:
    """(doc_id, columns of schema) from make(tokens), which gives each row's document and the columns."""
    out = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(schema)])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                doc, columns = make(Tokens(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc, pa.int64())), *columns], names)

    return spread(docs.select("doc_id", F.col(column).cast("string"))).mapInArrow(run, out)


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, id, kind, text, span_start, span_end, book, chapter, verse, marker, ...): the lossless tokens."""
    return over(docs, SCHEMA, lambda t: (t.doc, token_columns(t)))


def lexeme_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n): how many lexemes of each kind, white space apart from its neighbours."""

    def make(t: Tokens) -> Made:
        doc = np.repeat(np.arange(len(t.lexeme_counts)), t.lexeme_counts)
        grid = np.bincount(doc * len(KINDS) + t.lexeme_kind, minlength=len(t.counts) * len(KINDS))
        at = np.flatnonzero(grid)
        return at // len(KINDS), [named(at % len(KINDS), KINDS), pa.array(grid[at])]

    return over(docs, "kind string, n bigint", make)


def sources(docs: DataFrame) -> DataFrame:
    """(doc_id, source): the tokens' texts joined, which are the source."""
    return over(docs, "source string", lambda t: (np.flatnonzero(t.counts), [t.strings(t.start[t.first[:-1][t.counts > 0]], t.end[t.first[1:][t.counts > 0] - 1])]))


def books(docs: DataFrame) -> DataFrame:
    """(doc_id, first_book, last_book) of every document."""

    def make(t: Tokens) -> Made:
        codes, names = t._books()
        last = np.where(t.counts > 0, t.book_at[np.maximum(t.first[1:] - 1, 0)] if t.n else -1, -1)
        return np.arange(len(t.counts)), [named(codes[t.first_book], names), named(codes[last], names)]

    return over(docs, "first_book string, last_book string", make)


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n, first_idx): how many tokens each reference has, and the first."""

    def make(t: Tokens) -> Made:
        codes, _ = t._books()
        has = t.book_at >= 0
        key = np.stack([t.doc, codes[t.book_at], t.chapter * has, t.verse * has])
        _, first, n = np.unique(key, axis=1, return_index=True, return_counts=True)
        return t.doc[first], [t.references(first), pa.array(n), pa.array(t.idx[first].astype(np.int64))]

    return over(docs, "sid string, n bigint, first_idx bigint", make)


def verse_text(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, text): the text of each verse."""
    return over(docs, "ref string, text string", verse_rows)


def verse_rows(t: Tokens) -> Made:
    doc, ref, text = verses_.verses(t)
    return doc, [pa.array(ref, pa.string()), pa.array(text, pa.string())]


def verse_json(docs: DataFrame) -> DataFrame:
    """(doc_id, vref): each document's verses as a JSON object."""
    return over(docs, "vref string", lambda t: (np.arange(len(t.counts)), [pa.array(verses_.as_json(t), pa.string())]))


def marker_counts(docs: DataFrame) -> DataFrame:
    """(marker, n): occurrences of every marker name, counted in each pass before they are shuffled."""

    def make(t: Tokens) -> Made:
        n = np.bincount(t.marker[t.marker >= 0], minlength=len(t.names))
        return np.zeros(len(n), dtype=np.int64), [pa.array(t.names, pa.string()), pa.array(n)]

    return over(docs, "marker string, n bigint", make).where("n > 0").groupBy("marker").agg(F.sum("n").alias("n"))


def marker_info(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(marker, columns of the catalog, n): the markers in use and what is known of them."""
    at = [x.split()[0] for x in mk.SCHEMA.split(", ")]
    schema = StructType([StructField(f.name, f.dataType) for f in StructType.fromDDL(mk.SCHEMA) if f.name in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [mk.row(mk.bare(m)) if mk.canonical(m) else (None,) * len(at) for m in batch.column(0).to_pylist()]
            own = [pa.array([r[at.index(f.name)] for r in rows], pa.bool_() if f.dataType.typeName() == "boolean" else pa.string()) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, batch.column(1)], ["marker", *schema.names, "n"])

    return marker_counts(docs).mapInArrow(run, StructType([StructField("marker", StructType.fromDDL("a string")["a"].dataType), *schema, *StructType.fromDDL("n bigint")]))


_ENTRY = re.compile(ENTRY)


def attributes(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, n, entry_key, entry_value): entries of attribute lists, their escapes undone."""

    def make(t: Tokens) -> Made:
        rows = [(k, n, x, re.sub(r"\\(.)", r"\1", y)) for k in np.flatnonzero(t.kind == ATTRIBUTES).tolist() for n, (x, y) in enumerate(_ENTRY.findall(t.text(k)))]
        at = np.array([r[0] for r in rows], dtype=np.int64)
        return t.doc[at], [pa.array(t.idx[at], pa.int32()), *(pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.string())))]

    return over(docs, "idx int, n int, entry_key string, entry_value string", make)


def note_labels(docs: DataFrame, styles: tuple[str, ...] = ("alpha", "roman")) -> DataFrame:
    """(doc_id, idx, marker, number, label of each style, caller, book, chapter, verse): notes numbered in each document."""

    def make(t: Tokens) -> Made:
        note = (t.kind == MARKER) & t.is_name(*rules.NOTES)[t.marker]
        at = np.flatnonzero(note)
        number = t.count(note)[at]
        on = t.step(1)[at]
        caller = [t.text(k).strip(" \t") if k >= 0 else None for k in on.tolist()]
        codes, names = t._books()
        has = t.book_at[at] >= 0
        labels = [pa.array([ordinal(k, s) for k in number.tolist()], pa.string()) for s in styles]
        return t.doc[at], [pa.array(t.idx[at], pa.int32()), t.marker_names(at), pa.array(number), *labels, pa.array(caller, pa.string()), named(codes[t.book_at[at]], names), pa.array(t.chapter[at], mask=~has), pa.array(t.verse[at], mask=~has)]

    return over(docs, f"idx int, marker string, number bigint, {''.join(f'{s} string, ' for s in styles)}caller string, book string, chapter bigint, verse bigint", make)


# ---- lint


LINT_SCHEMA = "idx int, code string, sid string, marker string, span_start bigint, span_end bigint"


def lint(docs: DataFrame, enabled: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """(doc_id, idx, code, sid, marker, span_start, span_end): issues of the rules that look at neighbouring tokens."""
    return over(docs, LINT_SCHEMA, lint_rows(issues.allowed(enabled, disabled)))


def lint_rows(on: frozenset[str]) -> Callable[[Tokens], Made]:
    def make(t: Tokens) -> Made:
        hits = [(code, np.flatnonzero(mask)) for code, mask in rules.found(t) if code in on]
        at = np.concatenate([a for _, a in hits]) if hits else np.zeros(0, dtype=np.int64)
        code = np.repeat(np.arange(len(hits)), [len(a) for _, a in hits])
        order = np.argsort(at, kind="stable")
        at, code = at[order], code[order]
        codes = [c for c, _ in hits]
        whole = np.array([c == "missing-id-marker" for c in codes] + [False])[code]
        base = t.offsets[:-1][t.doc[at]]
        marker = pc.if_else(pa.array(whole), pa.scalar("id"), t.marker_names(at))
        sid = pc.if_else(pa.array(whole), pa.scalar(None, pa.string()), t.references(at))
        return t.doc[at], [pa.array(t.idx[at], pa.int32(), mask=whole), named(code, codes), sid, marker, pa.array(t.start[at] - base, mask=whole), pa.array(t.end[at] - base, mask=whole)]

    return make


def lint_issues(docs: DataFrame, enabled: list[str] | None = None, disabled: list[str] | None = None, implicit_verses: bool = False) -> DataFrame:
    """(doc_id, code, category, severity, issue_type, message, message_params, spans, ids, sid, marker, fix): all rules' issues.

    ``enabled`` keeps these codes only, ``disabled`` leaves some out; an issue that
    two rules find at one place counts once.
    """
    return over(docs, issues.SCHEMA, issue_rows(issues.allowed(enabled, disabled), implicit_verses))


def issue_rows(on: frozenset[str], implicit_verses: bool = False) -> Callable[[Tokens], Made]:
    def make(t: Tokens) -> Made:
        doc, rows = issues.records(t, on, implicit_verses)
        return doc, [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(issues.TYPES)]

    return make


def suppress(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Issues without those whose code and reference a table (code, sid) names; one without a reference always stays."""
    own = suppressions.select("code", "sid").where("code IS NOT NULL AND sid IS NOT NULL").distinct()
    return found.join(own, ["code", "sid"], "left_anti").select(*found.columns)


def summary(found: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """(doc_id, by_category, by_severity, by_issue_type, total_count, suppressed_count) of each document that has an issue."""
    if suppressions is not None:
        own = suppressions.select("code", "sid").where("code IS NOT NULL AND sid IS NOT NULL").distinct().withColumn("hit", F.lit(True))
        found = found.join(own, ["code", "sid"], "left")
    else:
        found = found.withColumn("hit", F.lit(None).cast("boolean"))
    kept = F.col("hit").isNull()

    def tally(column: str, names: tuple[str, ...]):
        counts = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.count_if(kept & (F.col(column) == n)) for n in names)))
        return F.map_filter(counts, lambda _, n: n > 0)

    parts = [tally(c, n).alias(f"by_{c}") for c, n in (("category", issues.CATEGORIES), ("severity", issues.SEVERITIES), ("issue_type", issues.ISSUE_TYPES))]
    return found.groupBy("doc_id").agg(*parts, F.count_if(kept).alias("total_count"), F.count_if(~kept).alias("suppressed_count"))


def code_counts(docs: DataFrame) -> DataFrame:
    """(code, n): issues of each code, counted in each pass before they are shuffled."""

    def make(t: Tokens) -> Made:
        hits = rules.found(t)
        return np.zeros(len(hits), dtype=np.int64), [pa.array([c for c, _ in hits]), pa.array([int(m.sum()) for _, m in hits])]

    return over(docs, "code string, n bigint", make).where("n > 0").groupBy("code").agg(F.sum("n").alias("n"))


def apply_fixes(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, text): tokens after the edits (doc_id, id, action, new_text) of a table.

    Actions are replace, delete and insert (after). An edit whose token isn't there
    does nothing; of several of one token the first in that order: delete, replace,
    insert, then by text. A document's edits meet its source in one join.
    """
    own = edits.groupBy("doc_id").agg(F.collect_list(F.struct("id", "action", "new_text")).alias("edits"))
    both = docs.select("doc_id", F.col("source").cast("string").alias("source")).join(own, "doc_id", "left")
    out = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("idx int, kind string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                t, chosen = Tokens(data, offsets), batch.column(2).slice(lo, hi - lo).to_pylist()
                own: list[tuple] = []
                ids = t.ids().to_pylist() if any(chosen) else []
                for d, wanted in enumerate(chosen):
                    if wanted:
                        where = {ids[k]: k for k in range(t.first[d], t.first[d + 1])}
                        own += [(where[e["id"]], e["action"], e["new_text"]) for e in wanted if e["id"] in where]
                doc, columns = edited(t, own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *columns], out.names)

    return both.mapInArrow(run, out)


_RANK = {"delete": 0, "replace": 1, "insert": 2}


def edited(t: Tokens, edits: list[tuple[int, str, str | None]]) -> Made:
    """Documents' tokens after edits (token, action, text)."""
    chosen: dict[int, tuple] = {}
    for k, action, text in sorted(edits, key=lambda e: (e[0], _RANK[e[1]], e[2] is not None, e[2] or "")):
        chosen.setdefault(k, (action, text))
    at = np.ones(t.n, dtype=np.int64)
    for k, (action, _) in chosen.items():
        at[k] = {"delete": 0, "replace": 1, "insert": 2}[action]
    of = np.repeat(t.at, at)
    rows = np.cumsum(at) - at
    texts = t.texts().take(pa.array(of))
    new = [(int(rows[k]) + (action == "insert"), text) for k, (action, text) in sorted(chosen.items()) if action != "delete"]
    if new:
        mask = np.zeros(len(of), dtype=bool)
        mask[[k for k, _ in new]] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([x for _, x in new], pa.string()))
    doc = t.doc[of]
    first = np.searchsorted(doc, np.arange(len(t.counts)))
    return doc, [pa.array(np.arange(len(of)) - first[doc], pa.int32()), t.kinds(of), texts]


def fixed(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, text): tokens after the fixes of missing separators, of repeated line breaks and of chapters without a break."""

    def make(t: Tokens) -> Made:
        back, on = t.step(-1), t.step(1)
        twice = (t.kind == NEWLINE) & (pick(t.kind, back, -1) == NEWLINE)
        chapter = (t.kind == NUMBER) & (pick(t.kind, back, -1) == MARKER) & t.is_name("c")[pick(t.marker, back, -1)] & (pick(t.kind, on, -1) != NEWLINE)
        glued = np.zeros(t.n, dtype=bool)
        glued[on[dict(rules.found(t))["missing-separator-after-marker"]]] = True
        edits = [(k, "delete", None) for k in np.flatnonzero(twice).tolist()] + [(k, "insert", "\n") for k in np.flatnonzero(chapter).tolist()]
        return edited(t, edits + [(k, "replace", " " + t.text(k)) for k in np.flatnonzero(glued).tolist()])

    return over(docs, "idx int, kind string, text string", make)


# ---- format rules of one look


def _rewritten(docs: DataFrame, new: Callable[[Tokens], pa.Array], kept: Callable[[Tokens], np.ndarray] | None = None) -> DataFrame:
    def make(t: Tokens) -> Made:
        at = t.at if kept is None else np.flatnonzero(kept(t))
        return t.doc[at], [pa.array(t.idx[at], pa.int32()), t.kinds(at), new(t).take(pa.array(at))]

    return over(docs, "idx int, kind string, text string", make)


def collapse_whitespace(docs: DataFrame) -> DataFrame:
    """Runs of spaces and tabs of text tokens become one space."""
    return _rewritten(docs, lambda t: pc.if_else(pa.array(t.kind == TEXT), pc.replace_substring_regex(t.texts(), "[ \t]+", " "), t.texts()))


def collapse_linebreaks(docs: DataFrame) -> DataFrame:
    """A line break right after another is dropped."""
    return _rewritten(docs, Tokens.texts, lambda t: ~((t.kind == NEWLINE) & (pick(t.kind, t.step(-1), -1) == NEWLINE)))


def line_start_space(docs: DataFrame) -> DataFrame:
    """Markers at the start of a line lose the white space before them."""

    def new(t: Tokens) -> pa.Array:
        at = (t.kind == MARKER) & np.isin(pick(t.kind, t.step(-1), NEWLINE), [NEWLINE])
        return pc.if_else(pa.array(at), pc.utf8_ltrim(t.texts(), " \t"), t.texts())

    return _rewritten(docs, new)


# ---- blocks

BLOCK_SCHEMA = "block_id string, semantic_sid string, begin bigint, end_exclusive bigint, prev_block_id string, text_full string, book string, chapter bigint"


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_id, semantic_sid, begin, end_exclusive, prev_block_id, text_full, book, chapter)."""
    return over(docs, BLOCK_SCHEMA, block_rows)


def block_rows(t: Tokens) -> Made:
    first, end = blocks_.borders(t)
    sid = pc.fill_null(t.references(first, "diff"), "")
    ids = pc.binary_join_element_wise(sid, t.ids(first), "::")
    new = t.doc[first] != np.concatenate([[-1], t.doc[first][:-1]])
    before = ids.take(pa.array(np.arange(len(first)) - 1, mask=new))
    codes, names = t._books()
    has, base = t.book_at[first] >= 0, t.first[:-1][t.doc[first]]
    text = t.strings(t.start[first], t.end[end - 1])
    return t.doc[first], [ids, sid, pa.array(first - base), pa.array(end - base), before, text, named(codes[t.book_at[first]], names), pa.array(t.chapter[first], mask=~has)]


DIFF_SCHEMA = (
    "block_id string, semantic_sid string, book string, chapter bigint, original_text string, current_text string, original_text_only string, current_text_only string, "
    "status string, undo_side string, is_whitespace_change boolean, is_usfm_structure_change boolean"
)


def over_pairs(pairs: DataFrame, schema: str, make: Callable[[Tokens, Tokens], Made], old: str = "baseline", new: str = "current") -> DataFrame:
    """(doc_id, columns of schema) from make(baseline's tokens, current's tokens) of a table with both versions in a row."""
    out = StructType([StructField("doc_id", pairs.schema["doc_id"].dataType), *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                doc, columns = make(Tokens(data, offsets), Tokens(*utf8(batch.column(2).slice(lo, hi - lo))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc, pa.int64())), *columns], out.names)

    return spread(pairs.select("doc_id", F.col(old).cast("string"), F.col(new).cast("string"))).mapInArrow(run, out)


@lru_cache(maxsize=4096)
def _parted(sid: str) -> tuple[str | None, int | None]:
    book, _, rest = sid.rpartition(" ")
    return (book, int(rest.split(":")[0])) if book else (None, None)


def _differences(found: list[tuple[int, blocks_.Difference]]) -> Made:
    """The rows of DIFF_SCHEMA, a column at a time."""
    own = [d for _, d in found]
    places = [_parted(d.semantic_sid) for d in own]
    text = lambda name: pa.array(map(attrgetter(name), own), pa.string())
    flag = lambda name: pa.array(map(attrgetter(name), own), pa.bool_())
    texts = [text(name) for name in ("block_id", "semantic_sid", "original_text", "current_text", "original_text_only", "current_text_only", "status", "undo_side")]
    columns = [*texts[:2], pa.array([b for b, _ in places], pa.string()), pa.array([c for _, c in places], pa.int64()), *texts[2:], flag("is_whitespace_change"), flag("is_usfm_structure_change")]
    return np.array([k for k, _ in found], dtype=np.int64), columns


def block_diff(pairs: DataFrame) -> DataFrame:
    """The blocks of both versions of each document in order, with status, side to undo and what changed."""

    def make(a: Tokens, b: Tokens) -> Made:
        return _differences([(k, d) for k, (x, y) in enumerate(zip(blocks_.of_documents(a), blocks_.of_documents(b))) for d in blocks_.diff(x, y)])

    return over_pairs(pairs, DIFF_SCHEMA, make)


def chapter_diff(pairs: DataFrame) -> DataFrame:
    """As block_diff, but each chapter's blocks are compared among themselves only."""

    def make(a: Tokens, b: Tokens) -> Made:
        return _differences([(k, d) for k, (x, y) in enumerate(zip(blocks_.of_documents(a), blocks_.of_documents(b))) for d in blocks_.flattened(blocks_.by_chapter(x, y))])

    return over_pairs(pairs, DIFF_SCHEMA, make)


def _stream(t: Tokens, d: int) -> blocks_.Stream:
    at = np.arange(t.first[d], t.first[d + 1])
    return list(zip(t.references(at, "diff").to_pylist(), t.ids(at).to_pylist(), [t.text(k) for k in at.tolist()]))


Choose = Callable[[list[blocks_.Pair]], list[str]]


def differing(matched: list[blocks_.Pair]) -> list[str]:
    """The ids of all blocks that differ."""
    return [block_id for block_id, a, b in matched if blocks_.status(a, b) != "Unchanged"]


def revert_blocks(pairs: DataFrame, wanted: DataFrame | Choose | None = None) -> DataFrame:
    """(doc_id, source): current's text with blocks as they are in baseline.

    ``wanted`` has (doc_id, block_ids), the ids to revert in turn, or is a function
    that takes them from a document's matched blocks, which needs no join; without
    it every block that differs is reverted.
    """
    pairs = pairs.select("doc_id", "baseline", "current")
    given = isinstance(wanted, DataFrame)
    if given:
        pairs = pairs.join(wanted.select("doc_id", F.col("block_ids").alias("ids")), "doc_id", "left")
    out = StructType([StructField("doc_id", pairs.schema["doc_id"].dataType), *StructType.fromDDL("source string")])
    choose = None if given else wanted or differing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                b = Tokens(*utf8(batch.column(2).slice(lo, hi - lo)))
                texts = []
                chosen = [None] * (hi - lo) if choose else batch.column(3).slice(lo, hi - lo).to_pylist()
                for d, (ids, old, new) in enumerate(zip(chosen, blocks_.of_documents(Tokens(data, offsets)), blocks_.of_documents(b))):
                    if choose:
                        ids = choose(blocks_.matched(old, new))
                    if ids:
                        texts.append("".join(blocks_.reverted(ids, old, new, [x.text for x in old], [x.text for x in new])))
                    else:
                        texts.append(b.raw[b.offsets[d] : b.offsets[d + 1]].decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.string())], out.names)

    return spread(pairs).mapInArrow(run, out)
